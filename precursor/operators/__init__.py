"""DataFrame operators: anchors, context, names, sequences, mining, evidence."""

"""Values that must equal the reference's for the results to match.

Stated plainly, in the order in which they appear in the reference.  Nothing
else in the package repeats these literals; it imports them from here.
"""

# --- Fixed values (in the reference's order) ---------------------------------------------------

# name prefixes: split on this delimiter; a generalised name ends with the suffix
NAME_DELIMITER = "-"
GENERALISED_SUFFIX = "-..."

# JSON paths of the target fields
PATH_LEVEL = "$.level"
PATH_SOURCE = "$.source"
PATH_REASON = "$.message.reason"
PATH_DISPLAY = "$.display"
PATH_CAUSE = "$.message.cause"
PATH_LOCATOR_TYPE = "$.locator.type"
PATH_KEYS_DISRUPTION = "$.locator.keys.disruption"
PATH_KEYS_ROUTE = "$.locator.keys.route"
PATH_KEYS_CONNECTION = "$.locator.keys.connection"
PATH_KEYS_BACKEND_DISRUPTION_NAME = "$.locator.keys.backend-disruption-name"
PATH_MESSAGE_HUMAN_MESSAGE = "$.message.humanMessage"
PATH_KEYS_NAMESPACE = "$.locator.keys.namespace"
PATH_KEYS_NS = "$.locator.keys.ns"

# the reference's workload
REFERENCE_SPAN_DAYS = 15
REFERENCE_WINDOW_BEFORE_SECONDS = 1    # the anchor may lie this much before the event (lookahead)
REFERENCE_WINDOW_AFTER_SECONDS = 40    # the anchor may lie this much after the event (lookback)
REFERENCE_JOB_INCLUDES = ("4.18", "azure")
REFERENCE_BACKEND_FAMILIES = (
    "service-load-balancer-%",
    "ingress-to-%",
    "cache-kube-api-%",
    "cache-%",
    "kube-api-%",
    "openshift-api-%",
    "oauth-api-%",
)
REFERENCE_NODE_SOURCE = "NodeUnexpectedNotReady"
REFERENCE_NODE_IGNORE_REASON = "NotReady"
REFERENCE_OBSERVER_ORIGIN = "e2e-events-observer.json"
DISPLAY_TRUE = "true"
REFERENCE_JOB_EXCLUDES = ("single-node",)

# position of an event relative to the anchor
AT_ANCHOR = "at_d"
AFTER_ANCHOR = "after_d"
BEFORE_ANCHOR = "before_d"

# JSON paths of the context fields
PATH_KEYS_NODE = "$.locator.keys.node"
PATH_KEYS_POD = "$.locator.keys.pod"
PATH_KEYS_CONTAINER = "$.locator.keys.container"
PATH_KEYS_UID = "$.locator.keys.uid"
PATH_KEYS_ROW = "$.locator.keys.row"
PATH_MESSAGE_ANNOTATIONS_CONSTRUCTED = "$.message.annotations.constructed"
PATH_MESSAGE_COUNT = "$.message.count"
PATH_MESSAGE_ROLES = "$.message.roles"
PATH_LOCATOR = "$.locator"

# context exclusions and the load-balancer noise rule
REFERENCE_CLOSING_REASON = "DisruptionEnded"
REFERENCE_BEGAN_REASON = "DisruptionBegan"
REFERENCE_BEGAN_KEEP_BACKEND = "%-liveness-%"
REFERENCE_NOISE_BACKEND = "service-load-balancer-with-pdb-reused-connections"
REFERENCE_NOISE_KUBE_EVENT = "KubeEvent"
REFERENCE_NOISE_NAMESPACES = ("openshift-kube-apiserver", "openshift-image-registry", "openshift-cluster-csi-drivers")
REFERENCE_NOISE_FAILED_SCHEDULING = "FailedScheduling"
REFERENCE_NOISE_ETCD = "EtcdLog"
REFERENCE_NOISE_ALERT = "Alert"
REFERENCE_NOISE_ALERT_MESSAGE = "%KubeDaemon%"

# masks
POD_SUFFIX_PATTERN = r"-[0-9a-fA-F]{8,10}(-.*|$)"
POD_SUFFIX_MASK = "-xxxxxxxxxx"
NODE_NAME_PATTERN = r"[a-zA-Z0-9.-]+"
NODE_MISSING = "no"
NODE_PRESENT = "yes"
HEX_PATTERN = r"[0-9a-fA-F]{8,30}"
HEX_MASK = "xxxxxxxxxx"
NUMBER_PATTERN = r"[0-9]{1,30}"
NUMBER_MASK = "###"

# event token: fields in this order, NULL as '_', 'field=value' pairs joined by ':'
EVENT_FIELDS = (
    "e_diff",
    "e_source",
    "e_node",
    "e_ns",
    "e_pod",
    "e_container",
    "e_reason",
    "e_cause",
    "e_roles",
    "e_row",
    "e_message",
)
NULL_PLACEHOLDER = "_"
TOKEN_SEPARATOR = ":"
TOKEN_ASSIGN = "="

# order of the events of a run after their time
EVENT_SORT_FIELDS = ("e_source", "e_ns", "e_reason", "e_message")

# mining: the k best closed patterns, reported when seen in more than one run
REFERENCE_TOP_K = 25
MIN_RUNS = 2

# display form of a token: every separator becomes a blank
DISPLAY_SEPARATOR = " "

# --- end of fixed values -----------------------------------------------------------------------

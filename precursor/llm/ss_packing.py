"""Sum-of-squares online packing of token sequences.

Each document becomes its token ids plus an end id.  Whole windows of the capacity are cut off as
full sequences; the rest is placed online: of all fill levels that have an open sequence (and a new
one), it goes to the level that minimises the sum of squared counts of partially filled sequences,
kept in an array indexed by level.  At the end of a task (or when very many sequences are open) the
emptiest open sequences are cut up to fill the fullest, so a task leaves at most one sequence that
needs padding.

Defined results: null and empty texts are the end id alone; repeated rows are packed as often as
they occur; an empty table gives no pieces; the ids of a document keep their order across its
pieces (``start``).  Rows are never moved between tasks: there is no shuffle, and a hot source or a
very long document costs no more than its tokens.  A task that runs again after a lost executor
gives the same pieces, since its input split and the sequence numbers derived from it are the same.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precursor.llm.common import slices, trimmed

CAPACITY = 2048
END_ID = 1
#: Open sequences a task holds before it fills them up (bounds memory to MAX_OPEN * CAPACITY ids).
MAX_OPEN = 4096
#: Parts of texts whose ids a worker remembers between blocks (a cache: it changes no result).
CACHED_PARTS = 400_000
# Space-separated parts made of these characters are split into words here; the others are left to the tokeniser.
_MARKS = r"!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~"
_PLAIN = rf"A-Za-zÀ-ÖØ-öø-ÿ0-9{_MARKS}"
_LINES = re.compile(rf"[{_PLAIN} \n]*")
_OTHER = re.compile(rf"(?<![^ \n])[{_PLAIN}]*+[^{_PLAIN} \n][^ \n]*+")
_HELD = "\x01"  # stands for a part left to the tokeniser
_BREAKS = re.compile(rf"[{_MARKS}]+|[0-9]|{_HELD}")  # words of their own beside the letters
#: Texts encoded together.
BLOCK = 256
_ENCODERS: dict[str | None, Callable[[list[str]], list[bytes]]] = {}
SCHEMA = "_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _word_encoder(tok) -> Callable[[str], tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
    """Ids of lines of plain words, and where among them the lines end and held parts stand.

    Words are merged by rank with the vocabulary's own merges.  The word end is marked by a space, which
    no word has: a letter and the mark merge first, then the vocabulary's merges follow in their order.
    None for a vocabulary of another kind.
    """
    spec = json.loads(tok.to_str())
    model, suffix = spec["model"], spec["model"].get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix or "Lowercase" not in json.dumps(spec["normalizer"]):
        return None
    # the byte alphabet: printable bytes stand for themselves, the others are numbered from 256 on
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}

    def raw(token: str) -> bytes:
        return bytes(byte[c] for c in token.removesuffix(suffix)) + b" " * token.endswith(suffix)

    vocab = {t: i for t, i in model["vocab"].items() if all(c in byte for c in t.removesuffix(suffix))}
    ranks = {bytes([b]): b for b in range(256)}
    ends = (t for t in sorted(vocab, key=vocab.get) if len(t) == 1 + len(suffix) and t.endswith(suffix))
    merged = ("".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"])
    for token in (*ends, *merged):
        ranks.setdefault(raw(token), len(ranks))
    ids = {ranks[raw(t)]: i for t, i in vocab.items() if raw(t) in ranks}
    id_of = np.array([ids.get(r, 0) for r in range(len(ranks))], dtype="<u4")

    import tiktoken

    # line ends and held parts are pieces of their own; the special token is never met, as no line has "<"
    words = tiktoken.Encoding("words", pat_str=rf"{_HELD}|[^ \n{_HELD}]+ |\n", mergeable_ranks=ranks,
                              special_tokens={"<|none|>": len(ranks)})

    def encode(lines: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        spaced = _BREAKS.sub(r" \g<0> ", lines.lower()).replace("\n", " \n")
        found = words.encode_to_numpy(spaced, disallowed_special=())
        return id_of[found], np.flatnonzero(found == ranks[b"\n"]), np.flatnonzero(found == ranks[_HELD.encode()])

    return encode


def encoder(path: str | None) -> Callable[[list[str]], list[bytes]]:
    """Texts to little-endian uint32 ids, one encoder per worker process.

    The vocabulary's pre-tokeniser drops white space and never joins across it, so the ids of a text
    are those of its space-separated parts.  Plain words of all texts are merged in one call; other
    parts are left to the tokeniser, and their ids are remembered.
    """
    if path in _ENCODERS:
        return _ENCODERS[path]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    else:
        tok = Tokenizer.from_file(path)
    seen: dict[str, bytes] = {}
    word_ids = _word_encoder(tok)

    def by_tokeniser(parts: list[str]) -> list[bytes]:
        if len(seen) > CACHED_PARTS:
            seen.clear()
        new = list(set(parts).difference(seen))
        for p, e in zip(new, tok.encode_batch(new, add_special_tokens=False), strict=True):
            seen[p] = np.array(e.ids, dtype="<u4").tobytes()
        out = [seen[p] for p in parts]
        for p in new:
            if len(p) > 64:  # too long to be worth remembering
                del seen[p]
        return out

    def by_words(texts: list[str]) -> list[bytes]:
        lines, held = "\n".join([t.replace("\n", " ") for t in texts] + [""]), []
        if not _LINES.fullmatch(lines):
            held = _OTHER.findall(lines)
            lines = _OTHER.sub(_HELD, lines)
        ids, ends, at_held = word_ids(lines)
        raw, others = ids.tobytes(), by_tokeniser(held)
        first = np.searchsorted(at_held, ends).tolist()  # held parts before each line's end
        out, at, k = [], 0, 0
        for end, last in zip((4 * ends).tolist(), first, strict=True):
            if k == last:
                out.append(raw[at:end])
            else:
                pieces = []
                for mark in (4 * at_held[k:last]).tolist():
                    pieces += (raw[at:mark], others[k])
                    at, k = mark + 4, k + 1
                out.append(b"".join([*pieces, raw[at:end]]))
            at = end + 4
        return out

    def encode(texts: list[str]) -> list[bytes]:
        if word_ids is None:
            return [b"".join(by_tokeniser([t] if "<|" in t else t.replace("\n", " ").split(" "))) for t in texts]
        # a special token's string may span parts, so such a text is encoded whole
        out = by_words(["" if "<|" in t else t for t in texts])
        whole = [i for i, t in enumerate(texts) if "<|" in t]
        for i, ids in zip(whole, by_tokeniser([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out

    _ENCODERS[path] = encode
    return encode


class SumOfSquares:
    """Online packing with one counter and one stack of open sequences per fill level."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by fill level
        self.open: dict[int, list[tuple[int, list]]] = {}    # level -> (sequence, its pieces)
        self.n_open = 0
        self.next = first_sequence

    def level(self, size: int) -> int:
        """The fill level (0: a new sequence) with the least sum of squares after adding ``size``."""
        n, cap = self.count, self.capacity
        best, least = 0, 1 if size == cap else 2 * int(n[size]) + 1
        if size < cap:
            if n[cap - size] and 1 - 2 * int(n[cap - size]) <= least:
                best, least = cap - size, 1 - 2 * int(n[cap - size])
            rise = np.where(n[1:cap - size] > 0, n[size + 1:cap] - n[1:cap - size], cap << 32)
            if len(rise):
                i = len(rise) - 1 - int(np.argmin(rise[::-1]))
                if 2 * int(rise[i]) + 2 < least:
                    best = i + 1
        return best

    def add(self, piece: tuple, size: int) -> Iterator[tuple[int, list]]:
        """Place a piece; yields the sequence if that fills it."""
        at = self.level(size)
        if at:
            seq, pieces = self.open[at].pop()
            self.count[at] -= 1
            self.n_open -= 1
        else:
            seq, pieces = self.next, []
            self.next += 1
        pieces.append(piece)
        if at + size == self.capacity:
            yield seq, pieces
        else:
            self.open.setdefault(at + size, []).append((seq, pieces))
            self.count[at + size] += 1
            self.n_open += 1

    def fill_up(self) -> Iterator[tuple[int, list]]:
        """Cut the emptiest open sequences into the gaps of the fullest; all but one come out full."""
        bins = [(lv, s, p) for lv in sorted(self.open, reverse=True) for s, p in self.open[lv]]
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        while bins:
            lv, seq, pieces = bins.pop(0)
            while lv < self.capacity and bins:
                from_lv, from_seq, rest = bins.pop()
                id, start, ids, total = rest.pop()
                have, room = len(ids) // 4, self.capacity - lv
                take = min(have, room)
                pieces.append((id, start, ids[:4 * take], total))
                lv += take
                if take < have:
                    rest.append((id, start + take, ids[4 * take:], total))
                if rest:
                    bins.append((from_lv - take, from_seq, rest))
            yield seq, pieces


def pack_rows(rows: Iterable[tuple[int | None, str | None]], encode: Callable[[list[str]], list[bytes]],
              capacity: int = CAPACITY, end_id: int = END_ID, first_sequence: int = 0) -> Iterator[tuple]:
    """(id, start, length, ids_crc32, doc_tokens, sequence, offset) of every piece."""
    end = np.array([end_id], dtype="<u4").tobytes()
    packer = SumOfSquares(capacity, first_sequence)

    def out(done: Iterable[tuple[int, list]]) -> Iterator[tuple]:
        for seq, pieces in done:
            at = 0
            for id, start, ids, total in pieces:
                n = len(ids) // 4
                yield id, start, n, zlib.crc32(ids), total, seq, at
                at += n

    for block in batched(rows, BLOCK):
        for (id, _), ids in zip(block, encode([text or "" for _, text in block]), strict=True):
            ids += end
            total = len(ids) // 4
            for start in range(0, total, capacity):
                part = ids[4 * start:4 * (start + capacity)]
                yield from out(packer.add((id, start, part, total), len(part) // 4))
            if packer.n_open > MAX_OPEN:
                yield from out(packer.fill_up())
    yield from out(packer.fill_up())


def _pack(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def rows():
        for b in slices(batches):
            yield from zip(b.column("_id").to_pylist(), b.column("_text").to_pylist(), strict=True)

    block: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*block, strict=True)], names=names)

    for piece in pack_rows(rows(), encode, capacity, end_id, TaskContext.get().partitionId() << 33):
        block.append(piece)
        if len(block) >= 10_000:
            yield batch()
            block.clear()
    if block:
        yield batch()


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return (docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))
            .mapInArrow(lambda it: trimmed(_pack(it, tokenizer_path, capacity, end_id)), SCHEMA)
            .withColumnRenamed("_id", id))

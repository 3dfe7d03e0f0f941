"""Byte-level BPE: overlapping chunks are pre-tokenised apart, stitched, and encoded piece by piece.

A text longer than a chunk becomes rows of its own per chunk. A chunk's row reads ``OVERLAP`` characters
before its start and enough after its end, so it finds where its own scan and its predecessor's meet: the
pattern looks at nothing before a match, so two scans that share one boundary share all later ones. The
row reports the first boundary at or after its start as it sees it, and the one at or after its end. A
document whose neighbours agree is stitched as it is; where they do not, because no boundary came within
the overlap, the document is scanned once more as a whole. Pieces are merged by rank with a bounded memo.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

CHUNK = 65_536
OVERLAP = 512
MEMO_PIECES = 150_000


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file: per line a base64 token and its rank. Bounded by the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Ids of pieces by rank merges, remembered for recent pieces as four bytes each.

    The memo has two generations of bounded size: a full one becomes the old one, and pieces still in use
    move over. It holds bytes alone, no objects per piece but a key and a value: each task has one.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.decimals = [str(i) for i in range(len(self.tokens))]
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode()
        known = self.ranks.get(raw)
        return (known,) if known is not None else self.merged(raw)

    def remember(self, piece: str) -> bytes:
        """The piece's ids, four bytes each."""
        entry = self.old.get(piece)
        if entry is None:
            entry = array("I", self.ids(piece)).tobytes()
        if len(piece) <= 64:
            if len(self.memo) >= MEMO_PIECES:
                self.old, self.memo = self.memo, {}
            self.memo[piece] = entry
        return entry

    def encode(self, pieces: list[str]) -> tuple[int, bytes, bytes]:
        """The number of ids, the ids in decimal joined by spaces, and the bytes they decode to."""
        known, more = self.memo.get, self.remember
        ids = array("I", b"".join([known(p) or more(p) for p in pieces])).tolist()
        return len(ids), " ".join(map(self.decimals.__getitem__, ids)).encode(), decode(ids, self.tokens)

    def merged(self, raw: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of least rank, leftmost first, until none is left."""
        if len(raw) > 256:
            return self.merged_long(raw)
        rank, none = self.ranks.get, len(self.tokens)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [rank(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            at = pairs.index(best)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], none)
        return tuple(map(self.ranks.__getitem__, parts))

    def merged_long(self, raw: bytes) -> tuple[int, ...]:
        """The same order of merges from a heap, for pieces of any length in n log n."""
        import heapq

        rank = self.ranks.get
        ends = list(range(1, len(raw) + 1))  # end of the part that starts at i
        before = list(range(-1, len(raw) - 1))
        alive = [True] * len(raw)

        def pair(i):
            j = ends[i]
            return rank(raw[i : ends[j]]) if j < len(raw) else None

        heap = [(r, i, ends[ends[i]]) for i in range(len(raw)) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, end = heapq.heappop(heap)
            j = ends[i]
            if not alive[i] or j >= len(raw) or ends[j] != end or rank(raw[i:end]) != r:
                continue
            alive[j] = False
            ends[i] = end
            if end < len(raw):
                before[end] = i
            for k in (before[i], i):
                if k >= 0 and (new := pair(k)) is not None:
                    heapq.heappush(heap, (new, k, ends[ends[k]]))
        return tuple(self.ranks[raw[i : ends[i]]] for i in range(len(raw)) if alive[i])


def decode(ids, tokens: list[bytes]) -> bytes:
    """The raw bytes of the ids, one after the other."""
    return b"".join(map(tokens.__getitem__, ids))


def chunk_view(scan, text: str, start: int, first: bool, last: bool, chunk: int, overlap: int):
    """Pieces of one chunk from its row's text, which begins at ``start`` of the chunk's document.

    Returns the boundary where the pieces begin, the boundary where they end and the pieces; both are
    places in the document. A last chunk ends with the text, any other where a piece crosses its end.
    """
    begin = 0 if first else overlap
    end = len(text) if last else begin + chunk
    at, pieces, begins = 0, [], None
    for match in scan.finditer(text):
        at = match.start()
        if at >= end and not last:
            return start + (at if begins is None else begins), start + at, pieces
        if at >= begin:
            begins = at if begins is None else begins
            pieces.append(match.group())
        at = match.end()
    if not last:  # the row's text ran out within a piece: its end is not to be trusted
        return start + (at if begins is None else begins), -1, pieces
    return start + (at if begins is None else begins), start + at, pieces


SPAN = "row long, key {}, stamp string, no int, begin long, end long, n long, ids binary, raw binary"


def encode_documents(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)`` per row of ``docs``.

    ``ids_sha256`` is the digest of the decimal ids joined by one space, ``decoded_sha256`` that of the bytes
    the ids decode to. Null texts are empty: no tokens, both digests of nothing. Repeated rows and keys stay
    rows of their own, null keys too; an empty table gives no rows; other columns are ignored.
    """
    coder = docs.sparkSession.sparkContext.broadcast(read_ranks(docs.sparkSession, vocabulary))  # the vocabulary
    kind = docs.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), body.alias("text"))

    def whole(batches):
        scan, encoder = regex.compile(pattern), Encoder(coder.value)
        for batch in batches:
            out = [_digest(*encoder.encode(scan.findall(t.as_py()))) for t in batch.column(1)]
            yield _result(batch.column(0), out)

    def spans(batches):
        scan, encoder = regex.compile(pattern), Encoder(coder.value)
        for batch in batches:
            cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            out = []
            for no, start, last, part in zip(*(cols[c].to_pylist() for c in ("no", "start", "last", "text"))):
                seen = chunk_view(scan, part, start, no == 0, last, chunk, overlap)
                begin, end, pieces = seen
                out.append((begin, end, *encoder.encode(pieces)))
            begins, ends, counts, id_bytes, raws = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [
                    cols["row"],
                    cols["key"],
                    cols["stamp"],
                    cols["no"],
                    pa.array(begins, pa.int64()),
                    pa.array(ends, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(id_bytes, pa.binary()),
                    pa.array(raws, pa.binary()),
                ],
                ["row", "key", "stamp", "no", "begin", "end", "n", "ids", "raw"],
            )

    def stitch(table):
        """One document: its chunks in order, if each begins where its predecessor ended."""
        table = table.sort_by("no")
        begins, ends = table.column("begin").to_pylist(), table.column("end").to_pylist()
        agree = begins[0] == 0 and begins[1:] == ends[:-1]
        ids, raws = hashlib.sha256(), hashlib.sha256()
        counts = table.column("n").to_pylist()
        first = True
        for own, raw in zip(table.column("ids"), table.column("raw")):
            if len(own.as_py()):
                ids.update((b"" if first else b" ") + own.as_py())
                first = False
            raws.update(raw.as_py())
        return pa.table(
            {
                "key": table.column("key")[:1],
                "stamp": table.column("stamp")[:1],
                "row": table.column("row")[:1],
                "agree": [agree],
                "n_tokens": [sum(counts)],
                "ids_sha256": [ids.hexdigest()],
                "decoded_sha256": [raws.hexdigest()],
            }
        )

    result = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    short = rows.where(F.length("text") <= chunk).select("key", "text").mapInArrow(whole, result)
    pieces = (
        rows.where(F.length("text") > chunk)
        .withColumn("stamp", F.sha2("text", 256))
        .withColumn("chars", F.length("text"))
        .withColumn("no", F.explode(F.expr(f"sequence(0, cast((chars - 1) div {chunk} as int))")))
        .withColumn("start", F.greatest(F.lit(0), F.col("no") * chunk - overlap))
        .withColumn("last", (F.col("no") + 1) * chunk >= F.col("chars"))
        .withColumn("text", F.expr(f"substring(text, start + 1, cast((no + 1) * {chunk} + {overlap} - start as int))"))
        .select("row", "key", "stamp", "no", "start", "last", "text")
        .repartition("row", "no")
    )
    stitched = Scratch(docs.sparkSession, "bpe").table(
        pieces.mapInArrow(spans, SPAN.format(kind))
        .groupBy("row")
        .applyInArrow(
            stitch,
            f"key {kind}, stamp string, row long, agree boolean, n_tokens long, ids_sha256 string, decoded_sha256 string",
        )
    )
    good = stitched.where("agree").select("key", "n_tokens", "ids_sha256", "decoded_sha256")
    again = rows.where(F.length("text") > chunk).withColumn("stamp", F.sha2("text", 256))
    lost = stitched.where(~F.col("agree")).select("stamp").distinct()
    again = again.join(lost, "stamp", "left_semi").select("key", "text").mapInArrow(whole, result)
    return short.unionByName(good).unionByName(again).withColumnRenamed("key", key)


def _digest(count: int, ids: bytes, raw: bytes) -> tuple[int, str, str]:
    return count, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()


def _result(keys, out):
    counts, ids, raws = zip(*out) if out else ((),) * 3
    return pa.RecordBatch.from_arrays(
        [keys, pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(raws, pa.string())],
        ["key", "n_tokens", "ids_sha256", "decoded_sha256"],
    )

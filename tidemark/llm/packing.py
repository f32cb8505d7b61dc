"""Packing of token runs into windows by multiway differencing.

Each text is tokenized once. It is cut into full windows and a rest of small pieces, and
each piece's checksum is taken at once, so only (document, start, length) rows go on. Rests
are laid end to end and cut in groups, and each group is split by Karmarkar and Karp's method:
a partial partition is a vector of window sums; the two whose sums differ most are merged,
the largest window of one with the smallest of the other, until one partition is left. If
its largest window exceeds the capacity, the window count rises and the group is split again.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.lineage import kept, small_batches
from tidemark.llm.wordcache import Recent, held, tidy

CAPACITY = 4096
#: Windows of one group: enough pieces for near-equal windows, few enough for one task.
GROUP_WINDOWS = 256
#: Largest piece of a rest: windows of a few pieces at least come out near equal.
PIECE = 512
CACHE_RUNS = 500_000
BATCH = 1000
WORD_END = "</w>"
#: Texts without characters whose form or length the tokenizer's normalizer changes, and their runs.
PLAIN = re.compile(r"[\n !-~\xa1-\xac\xae-\xff]*")
RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\n a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")


class WordIds:
    """Ids of a text by runs: this tokenizer drops white space and encodes runs alone.

    A plain text is cut as the tokenizer itself does, into runs of letters, digits and
    other marks; runs that are new are encoded together, as a call costs more than a run.
    In any other text only blanks and line feeds, white space by every definition, are cut
    at, and plain words between them go the same way.
    """

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.runs = Recent(self.encode_one, CACHE_RUNS)

    def encode_one(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        if PLAIN.fullmatch(text):
            return self.plain(text)
        words = text.replace("\n", " ").split(" ")
        return b"".join(self.plain(w) if PLAIN.fullmatch(w) else self.encode_one(w) for w in words if w)

    def plain(self, text: str) -> bytes:
        runs = RUNS.findall(text.lower())
        found = list(map(self.runs.young.get, runs))
        if None in found:
            old = self.runs.old
            self.encode_runs([r for r in {r for r, x in zip(runs, found, strict=True) if x is None} if r not in old])
            one = self.runs.one
            found = [one(r) if x is None else x for r, x in zip(runs, found, strict=True)]
        return b"".join(found)

    def encode_runs(self, runs: list[str]) -> None:
        for i in range(0, len(runs), BATCH):
            some = runs[i : i + BATCH]
            ids = np.asarray(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            # The last token of a run is one that ends a word, and no other token is.
            at = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            if len(at) != len(some):
                continue
            data, start = ids.tobytes(), 0
            for run, stop in zip(some, at, strict=True):
                self.runs.put(run, data[start:stop])
                start = stop


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, piece: int = PIECE, end_id: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): full windows of each text, then its rest in pieces.

    A null or empty text is its end id alone; a very long one is cut in as many windows as it
    fills. Repeated rows give repeated pieces and an empty table none. Only id and text are
    read, so other columns may have any name.
    """
    small_batches(docs.sparkSession)
    with open(path, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held(path, lambda: WordIds(raw.value))
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = words.ids(text or "") + end
                n = len(data) // 4
                rest = n - n % capacity
                cuts = [*range(0, rest, capacity), *range(rest, n, piece), n]
                for s, e in zip(cuts, cuts[1:], strict=False):
                    row.append(i)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(data[4 * s : 4 * e]))
                    total.append(n)
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(
        tidy(run, path), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each piece and the windows' sums, by multiway differencing."""
    n = len(sizes)
    if windows == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()])
    # A partial partition holds its non-zero sums in falling order; the rest of its windows are empty.
    sums = [np.array([s], np.int64) for s in sizes]
    slots: list[list] = [[[i]] for i in range(n)]

    def spread(v: np.ndarray) -> int:
        return int(v[0] - (v[-1] if len(v) == windows else 0))

    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        va, vb = sums[a], sums[b]
        over = len(va) + len(vb) - windows
        if over <= 0:
            # Each window of one meets an empty one of the other.
            new, parts = np.concatenate([va, vb]), slots[a] + slots[b]
        else:
            # The last windows of one are the smallest: they meet the largest of those that cannot be empty.
            kept_a, kept_b = len(va) - over, len(vb) - over
            met = va[kept_a:] + vb[kept_b:][::-1]
            new = np.concatenate([va[:kept_a], vb[:kept_b], met])
            parts = slots[a][:kept_a] + slots[b][:kept_b] + [[x, y] for x, y in zip(slots[a][kept_a:], slots[b][kept_b:][::-1], strict=True)]
        order = np.argsort(-new, kind="stable")
        sums[a], slots[a] = new[order], [parts[i] for i in order]
        sums[b], slots[b] = None, None
        heapq.heappush(heap, (-spread(sums[a]), a))
    last = heap[0][1]
    window = np.empty(n, np.int64)
    for w, tree in enumerate(slots[last]):
        stack = [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, list):
                stack.extend(x)
            else:
                window[x] = w
    return window, np.concatenate([sums[last], np.zeros(windows - len(sums[last]), np.int64)])


def split_group(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece; the count rises from the least possible until all fit."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = difference(sizes, windows)
        if sums.max() <= capacity:
            return window
        windows += max(1, windows // 256)


def numbered(rests: DataFrame) -> DataFrame:
    """Add part and upto to the rows: the task's number, and its tokens up to the end of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            upto = at + np.cumsum(batch.column("length").to_numpy())
            at = int(upto[-1]) if len(upto) else at
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(upto), part, np.int32)), pa.array(upto.astype(np.int64))], [*batch.schema.names, "part", "upto"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rests.schema.fields)
    return rests.mapInArrow(run, f"{kinds}, part int, upto long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS, piece: int = PIECE, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to the rows of ``cut_pieces``.

    A full piece is a window of its own. The pieces are written first, so their order stays
    the same if a task is run again. The rests are laid end to end in that order and cut in
    groups of just under ``group_windows`` windows, so every group but the last is as large
    as the others, whatever documents repeat or are hot. An empty table gives no rows.
    """
    pieces = kept(pieces)
    rests = numbered(pieces.where(F.col("length") < capacity))
    # One row a task: their sums are added up before them.
    sums = rests.groupBy("part").agg(F.max("upto").alias("tokens"))
    starts = sums.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start_at"))
    # A piece less than whole windows leaves differencing some room.
    size = max(capacity, capacity * group_windows - piece)

    def deal(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["id", "start", "at"], kind="stable").reset_index(drop=True)
        window = split_group(batch["length"].to_numpy(np.int64), capacity)
        batch["window"] = window
        batch["offset"] = batch.groupby("window")["length"].cumsum() - batch["length"]
        return batch

    kind = pieces.schema["id"].dataType.simpleString()
    columns = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    placed = rests.join(F.broadcast(starts), "part").withColumn("at", F.col("start_at") + F.col("upto") - F.col("length"))
    dealt = placed.select("id", "start", "length", "ids_crc32", "doc_tokens", "at", F.floor(F.col("at") / size).alias("group"))
    packed = dealt.groupBy("group").applyInPandas(deal, f"{columns}, at long, group long, window long, offset long")
    full = pieces.where(F.col("length") >= capacity).withColumns({"window": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rows = full.withColumn("sequence_id", F.col("window") * 2 + 1).unionByName(
        packed.withColumn("sequence_id", (F.col("group") * 2**24 + F.col("window")) * 2), allowMissingColumns=True
    )
    return rows.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(cut_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))

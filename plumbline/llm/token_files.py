"""Token ids in binary blocks, written by an adaptive context-mixing range coder.

Documents, in ascending order of their key, become one stream of ids with an end id after each.  The stream is cut into
segments by ranges of keys and each segment into blocks of BLOCK ids.  A block is coded on its own: all models start
anew, so any block can be read alone, and it carries a CRC-32 of its ids.

The model predicts an id from the two ids before it (order 2) or the one before it (order 1), each remembered in a
hashed table with a confidence.  Whether the better prediction holds is one binary decision; its probability is a
logistic mix of three adaptive ones, by order-2 confidence, by order-1 confidence and agreement, and by the recent hits
(order 0), with weights that learn from each outcome.  An id that was not predicted is coded by adaptive order-0
frequencies: its digits to base 16, each given the digits before it.  A range coder with a window of 48 bits turns the
probabilities into words of 16 bits.  All arithmetic is in integers, so reading repeats writing exactly on any machine.

Blocks don't depend on each other, so many of them are coded in step, one array operation for all: what a block would
do in a loop over bytes is done for LANES blocks at once.

The files are Parquet tables, `blocks` (segment, block, ids, crc, payload) and `index` (key, segment, start, n_tokens):
Parquet is only the container, so that writing is atomic on any shared store and survives lost executors.

Words are tokenised once and remembered: the tokenizer's pre-tokens never reach over ASCII white space, so a text's ids
are those of its words in a row.  The memory is bounded and emptied when full.

Nulls, ties and the like: a null text is empty and gives only the end id; rows with a null key come first; rows with
one key are ordered by their text and keep rows of their own; an empty table gives empty files.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import only_columns, staged

END_ID = 2
#: Ids of a block; order-0 counts stay below 2 ** 16 up to here.
BLOCK = 4096
#: Blocks that are coded in step.
LANES = 512
#: UTF-8 bytes of a segment, about.
SEGMENT_BYTES = 8_000_000
REMEMBERED = 200_000
#: UTF-8 bytes of the texts that are tokenised at a time.
PORTION = 1_000_000
SLOTS = 4096
GAIN = 12
#: ln(p / (1 - p)) * 256 for p = i / 4096, and back from -2047 to 2047.
STRETCH = np.array([round(256 * math.log((i + 0.5) / (4095.5 - i))) for i in range(4096)], np.int32)
SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-i / 256))))) for i in range(-2047, 2048)], np.int32)


#: The coder's window has 48 bits; words of 16 bits leave it when the range falls below 32.
WINDOW, LEAST = np.uint64(48), np.uint64(1 << 32)
U12, U16, U32 = np.uint64(12), np.uint64(16), np.uint64(32)
LOW32 = np.uint64((1 << 32) - 1)


class Encoder:
    """Range coders of many lanes.  `at` says which (indices, or a slice); the other arguments are arrays over them."""

    def __init__(self, lanes: int, room: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 48) - 1, np.uint64)
        self.out, self.used, self.lanes = np.zeros((lanes, room), np.uint16), np.zeros(lanes, np.int64), np.arange(lanes)

    def bit(self, at: np.ndarray | slice, p: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Code whether the decision holds, with probability p of 4096."""
        one = p.astype(np.uint64)
        unit = self.range[at] >> U12
        self._narrow(at, np.where(given, np.uint64(0), one * unit), np.where(given, one, np.uint64(4096) - one) * unit)
        return given

    def symbol(self, at: np.ndarray, cum: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Code symbols of distributions whose rows of cumulative counts are `cum`."""
        place = np.arange(0, cum.size, cum.shape[1]) + given
        start, end = cum.ravel().take(place).astype(np.uint64), cum.ravel().take(place + 1).astype(np.uint64)
        unit = self.range[at] // cum[:, -1].astype(np.uint64)
        self._narrow(at, start * unit, (end - start) * unit)
        return given

    def _narrow(self, at: np.ndarray | slice, below: np.ndarray, size: np.ndarray) -> None:
        low = self.low[at] + below
        over = np.flatnonzero(low >> WINDOW)
        if len(over):
            self._carry(self.lanes[at][over])
            low[over] &= np.uint64((1 << 48) - 1)
        go = np.flatnonzero(size < LEAST)
        if len(go):
            lanes = self.lanes[at][go]
            self.out[lanes, self.used[lanes]] = low[go] >> U32
            self.used[lanes] += 1
            low[go] = (low[go] & LOW32) << U16
            size[go] <<= U16
        self.low[at], self.range[at] = low, size

    def _carry(self, lanes: np.ndarray) -> None:
        """Add one to what the lanes have written; words that turn to zero pass it on."""
        back = 1
        while len(lanes):
            at = self.used[lanes] - back
            self.out[lanes, at] += np.uint16(1)
            lanes = lanes[self.out[lanes, at] == 0]
            back += 1

    def payloads(self) -> list[bytes]:
        for _ in range(3):
            self.out[self.lanes, self.used] = self.low >> U32
            self.used += 1
            self.low = (self.low & LOW32) << U16
        return [self.out[i, :n].astype("<u2").tobytes() for i, n in enumerate(self.used)]


class Decoder(Encoder):
    """The same steps with the outcomes read from the words.  `low` holds how far the words lie above the range's start."""

    def __init__(self, payloads: list[bytes]):
        super().__init__(len(payloads), max(map(len, payloads), default=0) // 2 + 4)
        for i, p in enumerate(payloads):
            self.out[i, : len(p) // 2] = np.frombuffer(p, "<u2")
        for _ in range(3):
            self.low = (self.low << U16) | self.out[self.lanes, self.used]
            self.used += 1

    def bit(self, at: np.ndarray | slice, p: np.ndarray, given: np.ndarray) -> np.ndarray:
        return super().bit(at, p, self.low[at] // (self.range[at] >> U12) < p.astype(np.uint64))

    def symbol(self, at: np.ndarray, cum: np.ndarray, given: np.ndarray) -> np.ndarray:
        total = cum[:, -1].astype(np.uint64)
        target = np.minimum(self.low[at] // (self.range[at] // total), total - np.uint64(1)).astype(np.uint16)
        return super().symbol(at, cum, np.count_nonzero(cum[:, 1:] <= target[:, None], axis=1))

    def _narrow(self, at: np.ndarray | slice, below: np.ndarray, size: np.ndarray) -> None:
        low = self.low[at] - below
        go = np.flatnonzero(size < LEAST)
        if len(go):
            lanes = self.lanes[at][go]
            low[go] = (low[go] << U16) | self.out[lanes, self.used[lanes]]
            self.used[lanes] += 1
            size[go] <<= U16
        self.low[at], self.range[at] = low, size


class Models:
    """The predictions of many lanes.  Tables are flat: lane after lane."""

    def __init__(self, lanes: int, digits: int):
        self.ids = [np.zeros(lanes * SLOTS, np.int32) for _ in range(2)]
        self.sure = [np.zeros(lanes * SLOTS, np.int8) for _ in range(2)]
        start = np.array([min(3900, 300 + 420 * c) for c in range(9)], np.int32)
        self.width = (9, 18, 16)
        self.chance = [np.tile(start, lanes), np.tile(np.repeat(start, 2), lanes), np.full(lanes * 16, 1400, np.int32)]
        self.weight = [np.full(lanes, 24000, np.int32) for _ in range(3)]
        self.history = np.zeros(lanes, np.int32)
        self.counts = [np.tile(np.arange(17, dtype=np.uint16), (lanes * 16**d, 1)) for d in range(digits)]


def code(coder: Encoder, sizes: np.ndarray, digits: int, ids: np.ndarray | None) -> np.ndarray:
    """Run the model over lanes of `sizes` ids, longest first; `ids` (lanes, ids) are given to write, None to read."""
    lanes = len(sizes)
    m = Models(lanes, digits)
    out = np.zeros((lanes, int(sizes.max(initial=0))), np.int32)
    before, last = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
    every = np.arange(lanes)
    slots, contexts, nodes = every * SLOTS, [every * w for w in m.width], [every * 16**d for d in range(digits)]
    gain = np.triu(np.full((16, 17), GAIN, np.uint16), 1)
    left = sizes.copy()
    k = lanes
    for t in range(out.shape[1]):
        while left[k - 1] <= t:
            k -= 1
        at = slice(0, k)
        hashed = last[at] * np.uint32(0x85EBCA6B)
        slot = [slots[at] + (((before[at] * np.uint32(0x9E3779B1) + hashed) >> 11) & (SLOTS - 1)), slots[at] + ((hashed >> 13) & (SLOTS - 1))]
        seen = [m.ids[o].take(slot[o]) for o in range(2)]
        sure = [m.sure[o].take(slot[o]) for o in range(2)]
        guess = np.where(sure[0] > 0, seen[0], seen[1])
        context = [contexts[0][at] + sure[0], contexts[1][at] + 2 * sure[1] + (seen[1] == guess), contexts[2][at] + m.history[at]]
        chance = [m.chance[j].take(context[j]) for j in range(3)]
        stretched = [STRETCH.take(c) for c in chance]
        mix = (m.weight[0][at] * stretched[0] + m.weight[1][at] * stretched[1] + m.weight[2][at] * stretched[2]) >> 16
        p = SQUASH.take(np.clip(mix, -2047, 2047) + 2047)
        given = None if ids is None else ids[at, t]
        hit = coder.bit(at, p, None if given is None else given == guess)
        goal = hit * np.int32(4095)
        error = goal - p
        for j in range(3):
            m.chance[j][context[j]] = chance[j] + ((goal - chance[j]) >> 4)
            m.weight[j][at] = np.clip(m.weight[j][at] + ((stretched[j] * error) >> 8), -200000, 200000)
        m.history[at] = ((m.history[at] << 1) | hit) & 15
        value = guess.copy()
        miss = np.flatnonzero(~hit)
        if len(miss):
            wanted = None if given is None else given[miss]
            node = np.zeros(len(miss), np.int64)
            for d in range(digits):
                row = nodes[d][miss] + node
                cum = m.counts[d].take(row, axis=0)
                digit = coder.symbol(miss, cum, None if wanted is None else (wanted >> 4 * (digits - 1 - d)) & 15)
                m.counts[d][row] = cum + gain.take(digit, axis=0)
                node = (node << 4) | digit
            value[miss] = node
        for o in range(2):
            right, firm = seen[o] == value, sure[o] > 2
            m.ids[o][slot[o]] = np.where(firm, seen[o], value)
            m.sure[o][slot[o]] = np.where(right, np.minimum(sure[o] + 1, 8), np.where(firm, sure[o] >> 1, 1))
        out[at, t] = value
        before[at], last[at] = last[at], value
    return out


def digits_of(vocabulary: int) -> int:
    """Digits to base 16 of the ids of a vocabulary."""
    return max(1, -(-(vocabulary - 1).bit_length() // 4))


def write_blocks(stream: np.ndarray, vocabulary: int) -> list[tuple[int, int, bytes]]:
    """(ids, crc, payload) of each block of a stream of ids."""
    done: list[tuple[int, int, bytes]] = []
    for start in range(0, len(stream), BLOCK * LANES):
        part = stream[start : start + BLOCK * LANES]
        sizes = np.full(-(-len(part) // BLOCK), BLOCK)
        sizes[-1] = len(part) - BLOCK * (len(sizes) - 1)
        ids = np.zeros(len(sizes) * BLOCK, np.int32)
        ids[: len(part)] = part
        coder = Encoder(len(sizes), 6 * min(BLOCK, len(part)) + 16)
        code(coder, sizes, digits_of(vocabulary), ids.reshape(-1, BLOCK))
        for i, payload in enumerate(coder.payloads()):
            done.append((int(sizes[i]), zlib.crc32(part[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()), payload))
    return done


def read_blocks(blocks: list[tuple[int, int, bytes]], vocabulary: int) -> np.ndarray:
    """The ids of blocks (ids, crc, payload), one after the other; a wrong checksum is an error."""
    found: list[np.ndarray] = [np.zeros(0, np.int32)] * len(blocks)
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    for start in range(0, len(order), LANES):
        part = order[start : start + LANES]
        sizes = np.array([blocks[i][0] for i in part])
        got = code(Decoder([blocks[i][2] for i in part]), sizes, digits_of(vocabulary), None)
        for row, i in enumerate(part):
            ids = got[row, : blocks[i][0]]
            if zlib.crc32(ids.astype("<u4").tobytes()) != blocks[i][1]:
                raise ValueError(f"block {i} is damaged")
            found[i] = ids
    return np.concatenate(found) if found else np.zeros(0, np.int32)


class WordTokens:
    """Ids of texts by remembered words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.vocabulary = self.tokenizer.get_vocab_size()

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, the end id last, as little-endian 32-bit numbers."""
        rows = [(t or "").encode().split() for t in texts]
        known = self.known
        fresh = list({w for row in rows for w in row if w not in known})
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = list({w for row in rows for w in row})
        for w, got in zip(fresh, self.tokenizer.encode_batch_fast([w.decode() for w in fresh], add_special_tokens=False)):
            known[w] = np.array(got.ids, "<u4").tobytes()
        end = np.array([END_ID], "<u4").tobytes()
        return [b"".join([*map(known.__getitem__, row), end]) for row in rows]


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about PORTION bytes of text each, one text at least: words of more are never held at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    parts = np.cumsum(sizes) // PORTION
    edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def written(docs: DataFrame, tokenizer_path: str, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Tokenise `docs` and write them: the tables (blocks, index) as read back from the shared folder.

    Texts are tokenised where they are read; only ids are shuffled, by ranges of the key.  A range is written by one
    task, which keeps at most LANES blocks at a time.
    """
    kind, key_type = docs.schema[key].dataType.simpleString(), to_arrow_type(docs.schema[key].dataType)
    rows = only_columns(docs, key, "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / SEGMENT_BYTES))
    marks = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    bounds = sorted(set(marks or []))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens(tokenizer_path)
        for batch in (part for whole in batches for part in _portions(whole)):
            texts, keys = batch.column("text").to_pylist(), batch.column(key).to_pylist()
            segments = [0 if k is None else int(np.searchsorted(bounds, k, side="right")) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(segments, pa.int32()), pa.array(words.of(texts), pa.binary()), pa.array([zlib.crc32((t or "").encode()) for t in texts], pa.int64())], [key, "segment", "ids", "tie"]
            )

    vocabulary = WordTokens(tokenizer_path).vocabulary

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "segment", "number", "n", "crc", "payload"]
        types = [key_type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        segment, held, waiting, blocks, at = None, [], 0, 0, 0

        def flush(all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting, blocks
            stream = np.frombuffer(b"".join(held), "<u4")
            keep = 0 if all_of_it else len(stream) % BLOCK
            done = write_blocks(stream[: len(stream) - keep].astype(np.int32), vocabulary)
            held, waiting = [stream[len(stream) - keep :].tobytes()], keep
            if done:
                columns = [[None] * len(done), [segment] * len(done), [*range(blocks, blocks + len(done))], *map(list, zip(*done))]
                blocks += len(done)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            sizes, starts = [], []
            for place, ids in zip(batch.column("segment").to_pylist(), batch.column("ids")):
                if place != segment:
                    yield from flush(True)
                    segment, blocks, at = place, 0, 0
                raw = ids.as_py()
                held.append(raw)
                sizes.append(len(raw) // 4)
                starts.append(at)
                at, waiting = at + len(raw) // 4, waiting + len(raw) // 4
                if waiting >= BLOCK * LANES:
                    yield from flush(False)
            nothing = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("segment"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), nothing, pa.nulls(batch.num_rows, pa.binary())], names)
        yield from flush(True)

    dealt = rows.mapInArrow(tokenise, f"`{key}` {kind}, segment int, ids binary, tie long").repartition(max(1, min(parts, 20_000)), "segment").sortWithinPartitions("segment", F.col(key).asc_nulls_first(), "tie")
    table = staged(dealt.mapInArrow(write, f"`{key}` {kind}, segment int, number long, n long, crc long, payload binary"), "token_files")
    blocks = table.where(F.col("payload").isNotNull()).select("segment", F.col("number").alias("block"), F.col("n").alias("ids"), "crc", "payload")
    index = table.where(F.col("payload").isNull()).select(key, "segment", F.col("number").alias("start"), F.col("n").alias("n_tokens"))
    return blocks, index


def read_back(blocks: DataFrame, index: DataFrame, tokenizer_path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the decoded blocks; start counts all ids before it."""
    kind = index.schema[key].dataType.simpleString()
    lengths = blocks.groupBy("segment").agg(F.sum("ids").alias("n"))
    offsets = lengths.withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    vocabulary = WordTokens(tokenizer_path).vocabulary
    documents = index.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("start", F.col("n_tokens").alias("n"), F.col(key).alias("k")))).alias("docs"))
    stored = blocks.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("block", "ids", "crc", "payload"))).alias("blocks"))
    joined = stored.join(documents, "segment").join(offsets, "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                base = batch.column("base")[i].as_py()
                ids = read_blocks([(b["ids"], b["crc"], b["payload"]) for b in batch.column("blocks")[i].as_py()], vocabulary).astype("<u4")
                docs = batch.column("docs").slice(i, 1).flatten()
                starts, sizes = docs.field("start").to_numpy(), docs.field("n").to_numpy()
                checks = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(starts, sizes)]
                yield pa.RecordBatch.from_arrays([docs.field("k"), pa.array(starts + base, pa.int64()), pa.array(sizes, pa.int64()), pa.array(checks, pa.int64())], [key, "start", "n_tokens", "ids_crc32"])

    return joined.select("base", "blocks", "docs").mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long")

"""Byte-level BPE encoding and decoding with a global distinct-word shuffle.

Texts are cut into pre-tokens and each pre-token's position is kept as the rank of its word in a local
dictionary, frequent words first. A block (about 16 MB of text) sends its distinct words, split by word
hash and packed, to the reducers of these hashes; there each word is encoded once, and its ids go back
to the block, where the positions put them in order. So text never moves: what moves is a byte or two
for each pre-token and the packed dictionaries. Decoding gathers from the token-byte table.

Pre-tokens are found with array operations over code points. The classes of code points (letter,
number, white space) are read off the tokenizer library's own regular expressions.

Defined cases: null text is empty, has no tokens and decodes to no bytes; repeated rows and repeated
or null ids keep one result row each; a text longer than a block is a block of its own, whole; an empty table
gives no rows; other columns do not matter, whatever their names. Words are told apart by their bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import textvec as tv

BLOCK = 16 << 20
OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
POINTS = 0x110000


@functools.lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@functools.lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point, by the library's own \\p{L}, \\p{N} and \\s."""
    import tiktoken

    table = np.zeros(POINTS, np.uint8)
    points = [i for i in range(POINTS) if not 0xD800 <= i < 0xE000]
    text = "".join(map(chr, points))
    single = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        e = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        table[np.frombuffer(bytes(e.encode_ordinary(text)).decode().encode("utf-32-le"), np.uint32)] = kind
    return table


@functools.lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table as one byte array and offsets by id."""
    ranks = load_ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        by_id[i] = token
    return np.frombuffer(b"".join(by_id), np.uint8), np.r_[0, np.cumsum([len(x) for x in by_id])]


def pre_tokens(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches in code points; `first` marks where texts begin.

    The pattern: contractions, then runs of letters, of numbers or of other signs with one blank
    before them, then white space, whose last character is left to what follows it. Matches leave
    nothing out, so each ends where the next starts.
    """
    c = classes()[points]
    n = len(c)
    start = first.copy()
    start[1:] |= c[1:] != c[:-1]
    run = np.flatnonzero(start)
    kind, ends = c[run], np.r_[run[1:], n]
    follows = np.r_[kind[1:], EDGE]
    follows[:-1][first[run[1:]]] = EDGE
    last = ends - 1
    joined = (kind == SPACE) & (follows != EDGE)
    blank = joined & (points[last] == 0x20)
    start[last[joined]] = True  # the last white space stands apart ...
    start[ends[blank]] = False  # ... and a blank goes with the next run
    quote = np.flatnonzero((points[run] == 0x27) & (ends - run == 1) & (follows == LETTER))
    quote = quote[(quote == 0) | ~blank[np.maximum(quote - 1, 0)]]
    if len(quote):
        at = run[quote]
        one = points[at + 1]
        two = np.where(at + 2 < ends[quote + 1], points[np.minimum(at + 2, n - 1)], 0)
        length = np.where(np.isin(one, [ord(x) for x in "stmd"]), 2, 0)
        for x in ("re", "ve", "ll"):
            length[(one == ord(x[0])) & (two == ord(x[1]))] = 3
        some = length > 0
        start[at[some] + 1] = False
        after = at[some] + length[some]
        start[after[after < n]] = True
    return np.flatnonzero(start)


def _block_rows(batches, block_bytes: int):
    """Blocks of rows with the digest of their texts: (batch, bytes, offsets, digest)."""
    for batch, data, offsets in tv.blocks(batches, "text", block_bytes):
        name = hashlib.blake2b(data.tobytes() + offsets.tobytes(), digest_size=8).digest()
        yield batch, data, offsets, int.from_bytes(name, "little", signed=True)


def _dictionary(data: np.ndarray, offsets: np.ndarray, piece: int = 1 << 20) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pre-tokens, frequent first, told apart by their bytes: (words, rank of each pre-token, number of
    pre-tokens before each row). Pre-tokens are found in pieces of the block that caches hold."""
    all_start, before = [], [np.zeros(1, np.int64)]
    at, rows, total = 0, len(offsets) - 1, 0
    while at < rows:
        to = min(rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + piece, "right")) - 1))
        part, own = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        head = np.flatnonzero((part & 0xC0) != 0x80)
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        edge = np.searchsorted(head, own)
        first = np.zeros(len(points) + 1, bool)
        first[edge] = True
        starts = pre_tokens(points, first[:-1]) if len(points) else np.zeros(0, np.int64)
        all_start.append(head[starts] + offsets[at])
        before.append(np.searchsorted(starts, edge[1:]) + total)
        total += len(starts)
        at = to
    # Matches leave nothing out, so each ends where the next starts.
    edges = np.concatenate([*all_start, [len(data)]]).astype(np.int64)
    values = pa.Array.from_buffers(pa.large_binary(), total, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    found = values.dictionary_encode()
    code, n = found.indices.to_numpy(), len(found.dictionary)
    order = np.argsort(-np.bincount(code, minlength=n), kind="stable")
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n)
    return found.dictionary.take(pa.array(order)), rank[code], np.concatenate(before)


def pack_ints(x: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Small numbers in 7-bit groups, low first, and the bytes that each takes; below 2**28."""
    x = x.astype(np.uint32)
    n = np.ones(len(x), np.int64) + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21)
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for i in range(4):
        some = n > i
        out[at[some] + i] = ((x[some] >> np.uint32(7 * i)) & np.uint32(127)) | np.where(n[some] > i + 1, 128, 0).astype(np.uint32)
    return out.tobytes(), n


def unpack_ints(b: bytes) -> np.ndarray:
    d = np.frombuffer(b, np.uint8)
    end = d < 128
    stop = np.flatnonzero(end)
    start = np.r_[0, stop[:-1] + 1] if len(stop) else stop
    out = np.zeros(len(stop), np.uint32)
    for i in range(4):
        some = start + i <= stop
        out[some] |= (d[start[some] + i] & 127).astype(np.uint32) << np.uint32(7 * i)
    return out.astype(np.int64)


def _word_rows(buckets: int, block_bytes: int):
    """(bucket, block, word ranks, words), packed: one row for each block and word-hash bucket."""

    def run(batches):
        for _, data, offsets, block in _block_rows(batches, block_bytes):
            words = _dictionary(data, offsets)[0]
            listed = words.to_pylist()
            lot = np.array([zlib.crc32(w) % buckets for w in listed], np.int64)
            # Like words side by side pack better.
            order = np.lexsort((pc.rank(words, tiebreaker="dense").to_numpy(), lot))
            lot = lot[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, lot[1:] != lot[:-1]]), len(lot)] if len(lot) else [0]
            for i, to in zip(cuts[:-1], cuts[1:], strict=True):
                own = order[i:to]
                part = [listed[k] for k in own.tolist()]
                lengths = pack_ints(np.array([len(w) for w in part]))[0]
                yield pa.RecordBatch.from_pylist([{"bucket": int(lot[i]), "block": block, "n": len(own), "lengths": len(lengths), "words": zlib.compress(lengths + b"".join(part), 1), "ranks": zlib.compress(own.astype("<u4").tobytes(), 1)}])

    return run


def _encode_rows(path: str, pattern: str):
    """Words of one bucket after another; each distinct word of a bucket is encoded once."""

    def run(batches):
        encode = encoding(path, pattern)._core_bpe.encode_single_piece
        held, known = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["bucket"] != held:
                    held, known = r["bucket"], {}
                blob = zlib.decompress(r["words"])
                ends = np.cumsum(unpack_ints(blob[: r["lengths"]])) + r["lengths"]
                starts = np.r_[r["lengths"], ends[:-1]]
                ids, counts = [], np.zeros(r["n"], np.int64)
                for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    w = blob[a:b]
                    got = known.get(w)
                    if got is None:
                        got = known[w] = encode(w)
                    ids += got
                    counts[i] = len(got)
                lengths = pack_ints(counts)[0]
                body = zlib.compress(np.array(ids, "<u4").tobytes() if ids and max(ids) > 65535 else lengths + np.array(ids, "<u2").tobytes(), 1)
                wide = bool(ids and max(ids) > 65535)
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "seq": 0, "key": None, "n": r["n"], "a": r["ranks"], "b": zlib.compress(lengths, 1) if wide else b"", "c": body, "lengths": 0 if wide else len(lengths)}], schema=_row_schema())

    return run


@functools.lru_cache(1)
def _row_schema():
    return pa.schema([("block", pa.int64()), ("seq", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("lengths", pa.int64())])


ROW = "block long, seq int, key long, n long, a binary, b binary, c binary, lengths long"


def _text_rows(block_bytes: int):
    """(block, seq >= 1, id, positions): the ranks of a text's pre-tokens in their order."""

    def run(batches):
        for batch, data, offsets, block in _block_rows(batches, block_bytes):
            _, rank, before = _dictionary(data, offsets)
            n = batch.num_rows
            packed, width = pack_ints(rank)
            at = np.r_[0, np.cumsum(width)][before].astype(np.int32)
            positions = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(packed)])
            nothing = pa.array([b""] * n, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(1, n + 1, dtype=np.int32)), batch.column(0), pa.array(np.diff(before)), positions, nothing, nothing, pa.array(np.zeros(n, np.int64))], schema=_row_schema())

    return run


def ragged(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The concatenated pieces flat[offsets[i]:offsets[i + 1]] for i in index."""
    count = (offsets[1:] - offsets[:-1])[index]
    total = int(count.sum())
    if not total:
        return flat[:0]
    at = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    return flat[at + np.repeat(offsets[:-1][index], count)]


def _join_rows(finish):
    """Sorted by block: its dictionary's ids come first, then its texts; finish(keys, ids of each text)."""

    def run(batches):
        block, ranks, counts, ids, flat, offsets = None, [], [], [], None, None
        for batch in batches:
            keys, done = [], []
            for r in batch.to_pylist():
                if r["block"] != block:
                    block, ranks, counts, ids, flat = r["block"], [], [], [], None
                if r["seq"] == 0:
                    if flat is not None:  # the same block was read twice: its dictionary is the same
                        continue
                    body = zlib.decompress(r["c"])
                    ranks.append(np.frombuffer(zlib.decompress(r["a"]), "<u4"))
                    counts.append(unpack_ints(zlib.decompress(r["b"]) if r["b"] else body[: r["lengths"]]))
                    ids.append(np.frombuffer(body, "<u4") if r["b"] else np.frombuffer(body[r["lengths"] :], "<u2"))
                    continue
                if flat is None:
                    rank = np.concatenate(ranks) if ranks else np.zeros(0, np.int64)
                    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
                    got = np.concatenate([x.astype(np.uint32) for x in ids]) if ids else np.zeros(0, np.uint32)
                    order = np.argsort(rank, kind="stable")
                    if len(order) and (rank[order] != np.arange(len(order))).any():
                        uniq = np.unique(rank, return_index=True)[1]
                        order = uniq
                    own = np.r_[0, np.cumsum(count)]
                    flat = ragged(got, own, order)
                    offsets = np.r_[0, np.cumsum(count[order])]
                index = unpack_ints(r["a"])
                if len(index) and index.max() >= len(offsets) - 1:
                    raise RuntimeError("a block's dictionary is missing: its rows came in another order on the second read")
                keys.append(r["key"])
                done.append(ragged(flat, offsets, index))
            if keys:
                yield finish(keys, done)

    return run


def _digest_batch(path: str):
    def finish(keys, texts):
        table, at = token_bytes(path)
        ids = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in texts]
        back = [hashlib.sha256(ragged(table, at, x.astype(np.int64)).tobytes()).hexdigest() for x in texts]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array(ids), pa.array(back)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return finish


def _ids_batch(keys, texts):
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([x.astype(np.int32) for x in texts], pa.list_(pa.int32()))], ["key", "ids"])


def _encoded(docs: DataFrame, id_col: str, text_col: str, path: str, pattern: str, block_bytes: int) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = texts.mapInArrow(_word_rows(buckets, block_bytes), "bucket long, block long, n long, lengths long, words binary, ranks binary")
    ids = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encode_rows(path, pattern), ROW)
    rows = texts.mapInArrow(_text_rows(block_bytes), ROW)
    return ids.unionByName(rows).repartition("block").sortWithinPartitions("block", "seq")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """(id, ids array<int>) of every text."""
    out = _encoded(docs, id_col, text_col, path, pattern, block_bytes).mapInArrow(_join_rows(_ids_batch), "key long, ids array<int>")
    return out.withColumnRenamed("key", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes) of every row of token ids, by the token-byte table; null ids are empty."""

    def run(batches):
        table, at = token_bytes(path)
        for b in batches:
            got = [ragged(table, at, np.array(x or [], np.int64)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["key", "bytes"])

    return tokens.select(F.col(id_col).cast("long").alias("key"), ids_col).mapInArrow(run, "key long, bytes binary").withColumnRenamed("key", id_col)


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """Per row: id, n_tokens, SHA-256 of the ids as little-endian 32-bit numbers and of the bytes that
    they decode to."""
    out = _encoded(docs, id_col, text_col, path, pattern, block_bytes).mapInArrow(_join_rows(_digest_batch(path)), "key long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", id_col)

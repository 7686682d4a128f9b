"""Packing: concatenate and cut. Prefix sums over the partitions' token totals give global offsets, then fixed windows cut what straddles them."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, ragged, stored, table

LENGTH, END = 2048, 1
#: Bytes of text that are encoded at once.
PIECE = 16 << 20
#: Punctuation that may follow a word of letters; a mark never joins the letters before it in one token.
CLOSING = ".,;:!?)]}\"*&%$#"
#: Words that the vectorised merging takes: letters whose lower case and composed form are plain. Longer ones go to the tokenizer.
LETTERS, LONGEST = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", 40
#: What a tokenizer must be for its words to be encoded one by one: normaliser and pre-tokenizer (fixed values of the public file).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
END_OF_WORD = "</w>"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def treats_words_alone(spec: dict) -> bool:
    """Whether the tokenizer of a file lower-cases, splits letters from marks, and merges by rank within a word only."""
    m, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = m["type"] == "BPE" and m.get("end_of_word_suffix") == END_OF_WORD and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    split = [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": SPLIT} and steps[0]["invert"] and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    return plain and split and spec.get("normalizer") == NORMALIZER and max(m["vocab"].values()) < 1 << 16


class Merges:
    """Byte pair merging of many words at once: in each round, every word merges its leftmost pair of the lowest rank."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, spec: dict):
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        # symbols of bytes within a word, then of bytes that end one
        self.symbol = np.array([vocab[sign[b] + e] for e in ("", END_OF_WORD) for b in range(256)], np.int32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.first = self.rank(np.repeat(self.symbol, 512), np.tile(self.symbol, 512)).reshape(512, 512)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        k = a.astype(np.int64) << 16 | b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[at] == k) & (a >= 0) & (b >= 0), self.ranks[at], self.NONE)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words, one after another, and how many each has."""
        data, starts, lens = raw(words)
        counts, parts, order = np.zeros(len(lens), np.int64), [], np.argsort(lens, kind="stable")
        for i in range(0, len(order), 16384):
            part = order[i : i + 16384]
            ids, n = self.chunk(data, starts[part], lens[part])
            counts[part] = n
            parts.append(ids)
        if not parts:
            return np.zeros(0, np.uint32), counts
        n = counts[order]
        firsts = np.empty(len(order), np.int64)
        firsts[order] = np.cumsum(n) - n
        return np.concatenate(parts)[ragged(firsts, counts)], counts

    def chunk(self, data, starts, lens):
        width, rows = int(lens.max()), np.arange(len(lens))
        code = data[np.minimum(starts[:, None] + np.arange(width), len(data) - 1)].astype(np.int32)
        code[rows, lens - 1] += 256
        inside = np.arange(width) < lens[:, None]
        sym = np.where(inside, self.symbol[code], -1)
        rank = np.where(inside[:, 1:], self.first[code[:, :-1], code[:, 1:]], self.NONE)
        out, counts = np.full((len(lens), width), -1, np.int32), lens.copy()
        while len(rows):
            j = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            best = rank[np.arange(len(rows)), j] if rank.shape[1] else np.full(len(rows), self.NONE)
            done = best == self.NONE
            if done.any():
                out[rows[done], : sym.shape[1]] = sym[done]
                go = ~done
                rows, sym, rank, j, best = rows[go], sym[go], rank[go], j[go], best[go]
                if not len(rows):
                    break
            at, place, new = np.arange(len(rows)), np.arange(sym.shape[1] - 1), self.made[best]
            counts[rows] -= 1
            sym = np.take_along_axis(sym, place + (place > j[:, None]), axis=1)
            sym[at, j] = new
            place = place[:-1]
            rank = np.take_along_axis(rank, place + (place >= j[:, None]), axis=1)
            if len(place):
                left, right = np.flatnonzero(j > 0), np.flatnonzero(j < len(place))
                rank[left, j[left] - 1] = self.rank(sym[left, j[left] - 1], new[left])
                rank[right, j[right]] = self.rank(new[right], sym[right, j[right] + 1])
        return out[out >= 0].astype(np.uint32), counts


def raw(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of an array of strings."""
    strings = pa.concat_arrays([strings.cast(pa.string())])
    _, offsets, data = strings.buffers()
    o = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    return np.frombuffer(data or b"\0", np.uint8), o[:-1], np.diff(o)


class WordEncoder:
    """Ids of texts. Where the tokenizer treats words between white space on their own, each different word of a piece is encoded
    once: a word of letters and closing marks as the letters, merged in numpy, and the marks; others by the tokenizer. Any other
    tokenizer encodes whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = Merges(spec) if treats_words_alone(spec) else None

    def ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by the tokenizer, joined by spaces, and how many each has, by their offsets."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 5000):
            part = words[i : i + 5000]
            enc = self.tok.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            starts = np.fromiter((a for a, _ in enc.offsets), np.int64, len(enc.offsets))
            counts.append(np.bincount(np.searchsorted(ends, starts, "right"), minlength=len(part)))
            ids.append(np.array(enc.ids, np.uint32))
        return np.concatenate(ids), np.concatenate(counts)

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of different words, one after another, and how many each has."""
        core = pc.utf8_rtrim(words, characters=CLOSING)
        plain = pc.and_(pc.match_substring_regex(core, LETTERS), pc.less_equal(pc.binary_length(core), LONGEST))
        core = pc.utf8_lower(core.filter(plain)).dictionary_encode()
        marks = pc.replace_substring_regex(words.filter(plain), LETTERS[:-1], "").dictionary_encode()
        got = [self.merges.encode(core.dictionary), self.ask(marks.dictionary.to_pylist()), self.ask(words.filter(pc.invert(plain)).to_pylist())]
        ids, n = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        starts, at = np.cumsum(n) - n, plain.to_numpy(zero_copy_only=False)
        cores, others = len(core.dictionary), len(core.dictionary) + len(marks.dictionary)
        unit = np.zeros((len(words), 2), np.int64)
        unit[at, 0], unit[at, 1] = core.indices.to_numpy(), cores + marks.indices.to_numpy()
        unit[~at, 0] = np.arange(others, len(n))
        counts = n[unit]
        counts[~at, 1] = 0
        return ids[ragged(starts[unit].ravel(), counts.ravel())], counts.sum(axis=1)

    def encode(self, texts: pa.Array, tail: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by tail, one after another, and how many each has."""
        if self.merges is None:
            got = [np.array([*e.ids, *tail], np.uint32) for e in self.tok.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *got]), np.fromiter(map(len, got), np.int64, len(got))
        words = pc.ascii_split_whitespace(texts)
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        ends -= ends[0]
        flat = words.flatten().dictionary_encode()
        ids, n = self.learn(flat.dictionary)
        ids, n = np.r_[ids, np.array(tail, np.uint32)], np.r_[n, len(tail)]
        word = np.insert(flat.indices.to_numpy(), ends[1:], len(n) - 1)
        many = n[word]
        last = np.r_[0, np.cumsum(many)][ends + np.arange(len(ends))]
        return ids[ragged((np.cumsum(n) - n)[word], many)], np.diff(last)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids and the end id. Documents follow each other in the order of the partitions of docs; the stream is
    cut at multiples of length, so every sequence but the last is full. Pass one encodes, writes ids and their place within
    the partition, and sums partitions; the totals (one number a partition) are prefix-summed on the driver; pass two adds
    them and cuts. Null text: empty, its end id alone. Null ids and repeated rows are kept: each row is packed. A text of
    any length makes as many pieces as it needs. Other columns are ignored. No rows: no rows.
    """
    path = path or tokenizer_path()

    def encode(batches):
        enc, at = WordEncoder(path), 0
        for b in batches:
            for part in pieces(b, 1, PIECE):
                ids, n = enc.encode(part.column(1), (end,))
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                offsets = np.r_[0, np.cumsum(4 * n)].astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([part.column(0), held, pa.array(n), pa.array(before)], ["doc_id", "ids", "n", "before"])

    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, "doc_id long, ids binary, n long, before long")
    encoded = stored(encoded.withColumn("part", F.spark_partition_id()), "ids")
    totals = sorted(tuple(r) for r in encoded.groupBy("part").agg(F.sum("n")).collect())
    base, at = {}, 0
    for part, n in totals:
        base[part] = at
        at += n
    base = docs.sparkSession.sparkContext.broadcast(base)

    def cut(batches):
        for b in batches:
            parts = np.fromiter((base.value[p] for p in b.column("part").to_pylist()), np.int64, b.num_rows)
            n, first = b.column("n").to_numpy(), b.column("before").to_numpy() + parts
            lo, hi = first // length, (first + n - 1) // length
            times = hi - lo + 1
            row = np.repeat(np.arange(len(n)), times)
            seq = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            a = np.maximum(first[row], seq * length)
            z = np.minimum(first[row] + n[row], (seq + 1) * length)
            start = a - first[row]
            ids = b.column("ids")
            for i in range(0, len(row), 4096):
                s = slice(i, i + 4096)
                held, views = -1, []
                for r, x, k in zip(row[s].tolist(), start[s].tolist(), (z - a)[s].tolist(), strict=True):
                    if r != held:
                        held, whole = r, ids[r].as_py()
                    views.append(whole[4 * x : 4 * (x + k)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row[s])), pa.array(start[s]), pa.array((z - a)[s]), pa.array(views, pa.binary()), pa.array(n[row[s]]), pa.array(seq[s]), pa.array(a[s] - seq[s] * length)], NAMES)

    return encoded.select("doc_id", "ids", "n", "before", "part").mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack(table(spark, sf_dir, "documents")))

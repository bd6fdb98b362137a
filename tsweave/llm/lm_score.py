"""Scores of all texts under a word model kept in Elias-Fano tries.

The corpus is cut into blocks of a bounded number of tokens, each with a
dictionary of its own. A block sends every distinct word and every distinct
pair of neighbours once, however often they occur, so that no frequent word
makes a frequent key. Shards add the counts of all blocks, build a trie of the
pairs, look every block's pairs up in it and send the codes back. A block then
scores its documents alone.

A pair's probability is ``(c(vw) + K * p(w)) / (c(v) + K)``: counts of the pair
smoothed towards the word's own add-one probability. The trie keeps the first
part as a code; a context's share ``K / (c(v) + K)`` follows from the count of
the word. A text's first word and its end have the end of a text as context
and word. Words never trained on count as one unknown word.

A shard holds all words after a context. Contexts so frequent that they would
fill a shard are dealt by the word too; there are at most ``8 * shards`` of
them, and they are found from the words' exact counts.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from tsweave.llm import text as T
from tsweave.llm.trie import Trie, decode, encode_log
from tsweave.session import materialise

#: Tokens of a block, and of the corpus for each shard.
BLOCK_TOKENS, SHARD_TOKENS = 1_500_000, 2_000_000
#: Weight of the word's own probability, in counts.
SMOOTHING = 300.0
#: The end of a text, as a token.
END = np.uint64(0xE0F0E0F0E0F0E0F1)
#: Words of a pair are told apart by so many bits after one context.
WORD_BITS = 40

_BLOCKS = (
    "block long, n_tokens long, doc_id array<long>, held_out array<boolean>, lengths binary, tokens binary, words binary, trained binary"
)


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of their bytes."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T.copy()
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(kind)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: its id's crc32 leaves 2 when divided by 7. A null id is trained on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Blocks of documents as numbers of their own dictionary, which holds word hashes in rising order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, count = TaskContext.get().partitionId() << 32, [], 0
        for batch in T.slices(batches):
            raw, at = T.laid_out(batch.column(1))
            begin, end, first = T.words_of(raw, at)
            word = np.insert(T.hashes(T.LOWER[raw], begin, end), first[1:], END)
            held.append((batch.column(0), batch.column(2), np.diff(first) + 1, word))
            count += len(word)
            if count >= block_tokens:
                yield block(number, held)
                number, held, count = number + 1, [], 0
        if held:
            yield block(number, held)

    def block(number, held) -> pa.RecordBatch:
        out = pa.concat_arrays([h[1] for h in held])
        length, word = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
        words, index = np.unique(word, return_inverse=True)
        train = np.repeat(~out.to_numpy(zero_copy_only=False).astype(bool), length)
        trained = np.bincount(index[train], minlength=len(words)).astype(np.uint32)
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        packed = [_pack(length.astype(np.uint32)), _pack(index.astype(np.uint32)), words.tobytes(), _pack(trained)]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([len(word)]), whole(pa.concat_arrays([h[0] for h in held])), whole(out), *(pa.array([p], pa.binary()) for p in packed)],
            ["block", "n_tokens", "doc_id", "held_out", "lengths", "tokens", "words", "trained"],
        )

    return docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(read, _BLOCKS)


@dataclass(frozen=True)
class _Dealer:
    """What a block sends to which shard, in the same order whenever it is asked."""

    shards: int
    heavy: np.ndarray  # rising

    @staticmethod
    def of(shards: int, heavy: dict[int, int]) -> _Dealer:
        return _Dealer(shards, np.sort(np.fromiter(heavy, np.uint64, len(heavy))))

    def words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order of a block's words by shard, and where each shard's begin."""
        shard = (T.mix(words ^ np.uint64(0x51)) % np.uint64(self.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(self.shards + 1))

    def pairs(self, words: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of a block: context and word numbers in order of shard, context and word; each token's pair; shard bounds."""
        before = np.empty_like(index)
        before[1:] = index[:-1]
        if len(index):
            before[0] = np.searchsorted(words, END)
        key, of = np.unique((before.astype(np.uint64) << np.uint64(32)) | index.astype(np.uint64), return_inverse=True)
        context, word = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        v, w = words[context], fingerprint(words[word])
        place = np.minimum(np.searchsorted(self.heavy, v), max(0, len(self.heavy) - 1))
        spread = self.heavy[place] == v if len(self.heavy) else np.zeros(len(v), bool)
        shard = (T.mix(np.where(spread, T.mix(v ^ w), v)) % np.uint64(self.shards)).astype(np.int64)
        order = np.lexsort((w, v, shard))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return context[order], word[order], rank[of], np.searchsorted(shard[order], np.arange(self.shards + 1))


def fingerprint(word: np.ndarray) -> np.ndarray:
    return word >> np.uint64(64 - WORD_BITS)


def _dealt_words(blocks: DataFrame, dealer: _Dealer) -> DataFrame:
    """Each block's words for their shards, with how often they occur and how often in training."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, tokens, words, trained in zip(*(c.to_pylist() for c in batch.columns)):
                words, trained = np.frombuffer(words, np.uint64), _unpack(trained, "<u4")
                count = np.bincount(_unpack(tokens, "<u4"), minlength=len(words)).astype(np.uint32)
                order, cut = dealer.words(words)
                rows = []
                for s in np.flatnonzero(np.diff(cut)).tolist():
                    own = order[cut[s] : cut[s + 1]]
                    rows.append((number, s, _delta(words[own]), _pack(count[own]), _pack(trained[own])))
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["block", "shard", "words", "n", "trained"])

    columns = blocks.select("block", "tokens", "words", "trained")
    return columns.mapInArrow(send, "block long, shard long, words binary, n binary, trained binary")


def _word_answers(dealt: DataFrame, floor: float) -> DataFrame:
    """Training counts of what each block sent. With null ``block``: each shard's totals, and its words that occur ``floor`` times or more."""

    def answer(table: pa.Table) -> pa.Table:
        rows, shard = sorted(table.to_pylist(), key=lambda r: r["block"]), table.column("shard")[0].as_py()
        parts = [_rising(r["words"]) for r in rows]
        words, of = np.unique(np.concatenate(parts), return_inverse=True)
        summed = lambda c: np.bincount(of, np.concatenate([_unpack(r[c], "<u4") for r in rows])).astype(np.int64)
        n, trained = summed("n"), summed("trained")
        ends = np.cumsum([0, *map(len, parts)])
        out = [(r["block"], shard, _pack(trained[of[a:b]].astype(np.uint64)), None, None, None) for r, a, b in zip(rows, ends, ends[1:])]
        out.append((None, shard, None, None, int(trained.sum()), int((trained > 0).sum())))
        out += [(None, shard, None, int(words[i : i + 1].view(np.int64)[0]), int(trained[i]), None) for i in np.flatnonzero(n >= floor).tolist()]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["block", "shard", "answer", "word", "tokens", "types"])

    return dealt.groupBy("shard").applyInArrow(answer, "block long, shard long, answer binary, word long, tokens long, types long")


def _dealt_pairs(blocks: DataFrame, dealer: _Dealer) -> DataFrame:
    """Each block's pairs for their shards: contexts, how many words follow each, the words, and training counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, out, lengths, tokens, words in zip(*(c.to_pylist() for c in batch.columns)):
                words, index = np.frombuffer(words, np.uint64), _unpack(tokens, "<u4")
                context, word, of, cut = dealer.pairs(words, index)
                train = np.repeat(~np.array(out, bool), _unpack(lengths, "<u4"))
                count = np.bincount(of[train], minlength=len(context)).astype(np.uint32)
                rows = []
                for s in np.flatnonzero(np.diff(cut)).tolist():
                    own = slice(cut[s], cut[s + 1])
                    head = np.flatnonzero(np.diff(context[own], prepend=-1))
                    runs = np.diff(np.append(head, cut[s + 1] - cut[s])).astype(np.uint32)
                    rows.append((number, s, _delta(words[context[own][head]]), _pack(runs), _pack(fingerprint(words[word[own]])), _pack(count[own])))
                kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
                names = ["block", "shard", "contexts", "runs", "words", "n"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    columns = blocks.select("block", "held_out", "lengths", "tokens", "words")
    return columns.mapInArrow(send, "block long, shard long, contexts binary, runs binary, words binary, n binary")


def _delta(rising: np.ndarray) -> bytes:
    return _pack(np.diff(rising, prepend=np.uint64(0)))


def _rising(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64)


def _pair_answers(dealt: DataFrame, heavy: dict[int, int], smoothing: float) -> DataFrame:
    """Codes of the pairs that each block sent, from a trie of the shard's trained pairs."""

    def answer(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        out = [(b, shard, _pack(c)) for b, c in pairs(sorted(table.to_pylist(), key=lambda r: r["block"]))]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.binary()])], ["block", "shard", "answer"])

    def pairs(rows: list[dict]) -> Iterator[tuple[int, np.ndarray]]:
        parts = [(np.repeat(_rising(r["contexts"]), _unpack(r["runs"], "<u4")), _unpack(r["words"], "<u8"), _unpack(r["n"], "<u4")) for r in rows]
        some = [n > 0 for *_, n in parts]
        context, word, n = (np.concatenate([p[k][s] for p, s in zip(parts, some)]) for k in range(3))
        order = np.lexsort((word, context))
        context, word, n = context[order], word[order], n[order].astype(np.int64)
        head = np.ones(len(context), bool)
        head[1:] = (context[1:] != context[:-1]) | (word[1:] != word[:-1])
        at = np.flatnonzero(head)
        n = np.add.reduceat(n, at) if len(at) else n
        context, word = context[at], word[at]
        _, of = np.unique(context, return_inverse=True)
        total = np.bincount(of, n)[of] if len(of) else np.zeros(0)
        if heavy and len(context):  # their words lie in many shards
            values = np.sort(np.fromiter(heavy, np.uint64, len(heavy)))
            place = np.minimum(np.searchsorted(values, context), len(values) - 1)
            spread = values[place] == context
            total[spread] = np.array([heavy[v] for v in values.tolist()], float)[place[spread]]
        built = Trie.of(context, word, encode_log(np.log10(n / (total + smoothing))) if len(n) else np.zeros(0, np.uint16))
        del context, word, n, total
        with tempfile.TemporaryDirectory() as folder:
            built.save(folder)
            trie = Trie.open(folder)
            for r, (v, w, _) in zip(rows, parts):
                yield r["block"], trie.lookup(v, w)

    return dealt.groupBy("shard").applyInArrow(answer, "block long, shard long, answer binary")


def score_documents(docs: DataFrame, smoothing: float = SMOOTHING, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    ``base_score`` sums add-one log10 probabilities of single tokens, ``score`` is the log10 probability
    of the text under the pair model. Null and empty texts are one token, the end. Repeated rows are scored
    alike and each counts in training; a null id is trained on; other columns are not read.
    """
    blocks = materialise(_blocks(docs, block_tokens), "blocks")
    tokens = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-tokens // shard_tokens))
    counted = materialise(_word_answers(_dealt_words(blocks, _Dealer.of(shards, {})), tokens / (8 * shards)), "word-counts")
    sums = counted.where("block IS NULL AND word IS NULL").agg(F.sum("tokens"), F.sum("types")).first()
    n_trained, n_types = int(sums[0] or 0), int(sums[1] or 0)
    # At most eight words a shard occur so often.
    heavy = {r["word"] & (1 << 64) - 1: r["tokens"] for r in counted.where("word IS NOT NULL").select("word", "tokens").collect()}
    dealer = _Dealer.of(shards, heavy)
    coded = _pair_answers(_dealt_pairs(blocks, dealer), heavy, smoothing)
    answers = counted.where("block IS NOT NULL").select("block", "shard", F.lit(0).alias("kind"), "answer").unionByName(
        coded.select("block", "shard", F.lit(1).alias("kind"), "answer")
    )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        words, index, length = np.frombuffer(row["words"], np.uint64), _unpack(row["tokens"], "<u4"), _unpack(row["lengths"], "<u4")
        got: dict[int, dict[int, bytes]] = {0: {}, 1: {}}
        for kind, shard, data in zip(*(right.column(c).to_pylist() for c in ("kind", "shard", "answer"))):
            got[kind][shard] = data
        order, _ = dealer.words(words)
        known = np.empty(len(words), np.int64)
        known[order] = np.concatenate([_unpack(got[0][s], "<u8") for s in sorted(got[0])]).astype(np.int64)
        context, _, of, _ = dealer.pairs(words, index)
        code = np.concatenate([_unpack(got[1][s], "<u2") for s in sorted(got[1])])
        single = (known + 1) / (n_trained + n_types + 1)
        weight = smoothing / (known[context] + smoothing)
        each = np.log10(decode(code)[of] + weight[of] * single[index])
        ends = np.concatenate([[0], np.cumsum(length.astype(np.int64))])
        summed = lambda x: np.add.reduceat(x, ends[:-1]) if len(x) else np.zeros(0)
        return pa.Table.from_arrays(
            [
                pa.array(row["doc_id"], pa.int64()), pa.array(row["held_out"], pa.bool_()), pa.array(length.astype(np.int64)),
                pa.array(T.totals(known[index] > 0, ends)), pa.array(np.full(len(length), n_trained)),
                pa.array(summed(np.log10(single)[index])), pa.array(summed(each)),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    replies = answers.select(F.col("block").alias("for_block"), "kind", "shard", "answer")
    return (
        blocks.select("block", "doc_id", "held_out", "lengths", "tokens", "words").groupBy("block")
        .cogroup(replies.groupBy("for_block")).applyInArrow(score, schema)
    )

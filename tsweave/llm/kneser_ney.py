"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is one of whole characters (code points), of order 5, for each
language and for all languages together. Texts are written once as packed
blocks. Each block sends its distinct n-grams once; those of trusted texts are
counted, and the levels below count by how many characters stood before. The
n-grams that blocks ask for meet the counts of their own, the totals of their
context and the probability of their shorter form in joins that are dealt by
language and context, level by level. Shards send the answers back, and a block
scores its documents alone. Lists of n-grams travel packed; a context lies in
one shard, so that what depends on it alone is sent back once.

Below single characters lies a small model of character classes, which shares
a class's probability among its characters, so that characters never trained on
have one too. It has ``32 ** 4`` numbers a language and is handed to the tasks.
Each level has its own three discounts, from its counts of counts.

A document is kept when its perplexity lies between two quantiles of the
trusted documents of its language: above them is gibberish, below them text
that repeats itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window, functions as F

from tsweave.llm import text as T
from tsweave.llm.language import code_of
from tsweave.llm.lm_score import _pack, _unpack
from tsweave.llm.quantiles import order_statistics
from tsweave.llm.trusted import trusted_ids
from tsweave.session import materialise, materialise_buckets

#: Characters of an n-gram, and bits of one character. The last three lie in ``b``, those before them in ``a``; 0 stands before a text.
LENGTH, CHAR_BITS = 5, 21
#: Bytes of text in a block, and packed bytes of text for each shard.
BLOCK_BYTES, SHARD_BYTES = 16 << 20, 32 << 20
#: Text of a block handled at once. Scoring took a worker 245 MB at most, with twice as much text 297 MB.
SLICE_BYTES = 1 << 20
STORED = ["block", "doc_id", "code", "lengths", "texts", "size"]
#: Keys up to this number are told apart by a table, others by sorting.
DIRECT = 1 << 23
#: Order of the model of classes, and bits of a class.
ORDER, BITS = 4, 5
CLASSES = 1 << BITS
#: ``a`` of n-grams of classes; no character has this number.
OF_CLASSES = (1 << CHAR_BITS) - 1
#: The model of all languages together.
ANY = "*"
#: Quantiles of trusted perplexities, and by how much a document may pass them.
LOW, HIGH, SLACK = 0.001, 0.999, 1.03
#: Standard deviation of a character's log probability: means of short texts stray further.
SPREAD = 1.5
#: Trusted documents that a language needs for thresholds and a model of its own.
LEAST_DOCUMENTS = 50
#: Languages with a model of their own, those of the most trusted documents; the model of all serves the others.
MOST_LANGUAGES = 64

_CLASS = np.full(256, 31, np.uint32)
_CLASS[:128] = 30
_CLASS[[*range(97, 123)]] = np.arange(1, 27)
_CLASS[[*range(65, 91)]] = np.arange(1, 27)
_CLASS[[*range(48, 58)]] = 27
_CLASS[[0x20, *range(0x09, 0x0E)]] = 28
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 29
_LATER = np.zeros(256, bool)
_LATER[0x80:0xC0] = True
#: Characters that share a class's probability; surrogates are none.
_SIZE = np.maximum(1, np.bincount(_CLASS[:128], minlength=CLASSES))
_SIZE[31] = 0x110000 - 0x800 - 128


def _grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every character with the three before it as one number, 0 before a text, and where each text's begin."""
    lead = ~_LATER[raw]
    at = np.concatenate([[0], np.cumsum(lead)])[at]
    kind = _CLASS[raw[lead]]
    key = kind.copy()
    for back in range(1, ORDER):
        before = np.zeros_like(kind)
        before[back:] = kind[: max(0, len(kind) - back)]
        for k in range(back):
            starts = at[:-1] + k
            before[starts[starts < at[1:]]] = 0
        key |= before << np.uint32(BITS * back)
    return key.astype(np.int64), at


def _dense(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below ``size`` in rising order, and each key's place among them."""
    if size > DIRECT:
        return np.unique(key, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[key] = True
    found = np.flatnonzero(seen)
    place = np.empty(size, np.int32)
    place[found] = np.arange(len(found), dtype=np.int32)
    return found, place[key]


def _distinct(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams that end at a character of some texts, as ``a`` and ``b``, and the n-gram of every character."""
    char = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4") + np.uint32(1)
    if not len(char):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(~_LATER[raw])])[at]
    # Arrays are as long as the texts: they are changed in place, and dropped when done with.
    real = T.owners(first)
    real += 1
    real *= LENGTH - 1
    real += np.arange(len(char))
    row = np.zeros(len(char) + (LENGTH - 1) * (len(at) - 1), np.int32)
    row[real] = char
    del char
    letters, letter = _dense(row, 1 << CHAR_BITS)
    kinds, of = letters, letter
    key = np.zeros(len(row), np.int64)
    for _ in range(LENGTH - 2):
        key[1:] = of[:-1]
        key *= len(letters)
        key += letter
        kinds, of = _dense(key, len(kinds) * len(letters))
        key[0] = 0
    del key
    key = of[real - 1].astype(np.int64)
    key *= len(letters)
    key += letter[real]
    del letter, of
    kinds, of = _dense(key, len(kinds) * len(letters))
    last = np.empty(len(kinds), np.int64)
    last[of] = real
    older = [row[last - k].astype(np.int64) << (CHAR_BITS * (k % 3)) for k in range(LENGTH)]
    return older[3] | older[4], older[0] | older[1] | older[2], of


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of several lists in rising order, each once with the sum of its counts."""
    a, b, n = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)])
    return a[head], b[head], np.add.reduceat(n, head) if len(head) else n


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return T.mix(a.astype(np.uint64) * T.ODD + T.mix(b.astype(np.uint64)))


def stored(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id, text, lang``) as blocks of packed texts, written once in buckets by block, so that no text is shuffled."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in T.slices(batches):
            raw, at = T.laid_out(batch.column(1))
            held.append((batch.column(0), batch.column(2), np.diff(at).astype(np.uint32), raw.tobytes()))
            size += len(raw)
            if size >= BLOCK_BYTES:
                yield block(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield block(number, held)

    def block(number, held) -> pa.RecordBatch:
        whole = lambda parts: pa.ListArray.from_arrays(pa.array([0, sum(map(len, parts))], pa.int32()), pa.concat_arrays(parts))
        texts = zstandard.ZstdCompressor(level=5).compress(b"".join(h[3] for h in held))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number]), whole([h[0] for h in held]), whole([h[1] for h in held]),
                pa.array([_pack(np.concatenate([h[2] for h in held]))]), pa.array([texts], pa.binary()), pa.array([len(texts)]),
            ],
            STORED,
        )

    schema = "block long, doc_id array<long>, code array<string>, lengths binary, texts binary, size long"
    rows = docs.select(F.col("doc_id").cast("long"), "text", code_of(F.col("lang")).alias("code")).mapInArrow(T.tidy(store), schema)
    return materialise_buckets(rows, "texts", "block")


def _places(texts: DataFrame) -> DataFrame:
    """``block, place, doc_id, code`` of every document."""
    return texts.select("block", F.posexplode(F.arrays_zip("doc_id", "code")).alias("place", "row")).select("block", "place", "row.doc_id", "row.code")


def _opened(row: dict, place: np.ndarray, model: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """A block's texts at ``place``, those of one model after the other: its name, places, bytes and bounds, slice by slice."""
    at = np.concatenate([[0], np.cumsum(_unpack(row["lengths"], "<u4").astype(np.int64))])
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, int(at[-1]))), np.uint8)
    for name in sorted(set(model)):
        own = np.sort(place[model == name])
        size = np.cumsum(at[own + 1] - at[own])
        begin = 0
        while begin < len(own):
            end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + SLICE_BYTES, "right")))
            some = own[begin:end]
            yield name, some, np.concatenate([raw[at[p] : at[p + 1]] for p in some]), np.concatenate([[0], np.cumsum(at[some + 1] - at[some])])
            begin = end


def _named(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("place").to_numpy(), np.array(table.column("model").to_pylist(), object)


def _shards(texts: DataFrame) -> int:
    return max(1, -(-(texts.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES))


def _lists(texts: DataFrame, named: DataFrame, shards: int, counted: bool) -> DataFrame:
    """``block, model, shard, grams, n``: each block's distinct n-grams of the texts that ``named`` (``block, place, model``) names, by model and for their shards.

    ``counted`` lists say how often each occurs, and list the n-grams of classes too.
    """

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        found, classes = {}, {}
        if left.num_rows and right.num_rows:
            for name, _, raw, at in _opened(left.to_pylist()[0], *_named(right)):
                a, b, of = _distinct(raw, at)
                found[name] = _merged([*([found[name]] if name in found else []), (a, b, np.bincount(of, minlength=len(a)))])
                if counted:
                    classes[name] = classes.get(name, 0) + np.bincount(_grams(raw, at)[0], minlength=CLASSES**ORDER)
        T.give_back()
        rows = []
        for name, (a, b, n) in [*found.items(), *((k, (np.full(np.count_nonzero(c), OF_CLASSES), np.flatnonzero(c), c[c > 0])) for k, c in classes.items())]:
            # Classes, which all have the same context here, are dealt one by one.
            shard = (_mixed(a, np.where(a == OF_CLASSES, b, b >> CHAR_BITS)) % np.uint64(shards)).astype(np.int64)
            for k in np.unique(shard).tolist():
                own = shard == k
                rows.append((left.column("block")[0].as_py(), name, k, _packed(a[own], b[own]), _pack(n[own].astype(np.uint32)) if counted else None))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["block", "model", "shard", "grams", "n"])

    met = texts.select("block", "lengths", "texts").groupBy("block").cogroup(named.groupBy(F.col("block").alias("for_block")))
    return met.applyInArrow(read, "block long, model string, shard long, grams binary, n binary")


def _packed(a: np.ndarray, b: np.ndarray) -> bytes:
    """N-grams as compressed planes of their characters' bytes."""
    return _pack(np.concatenate([x >> (CHAR_BITS * k) & OF_CLASSES for x, k in ((a, 1), (a, 0), (b, 2), (b, 1), (b, 0))]).astype(np.uint32))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    c = _unpack(data, "<u4").astype(np.int64).reshape(LENGTH, -1)
    return c[0] << CHAR_BITS | c[1], c[2] << 2 * CHAR_BITS | c[3] << CHAR_BITS | c[4]


def _heads(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which n-grams of a rising list are the first of their context."""
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] >> CHAR_BITS != b[:-1] >> CHAR_BITS)
    return head


def _summed(table: pa.Table) -> pa.Table:
    """Each n-gram of a shard's lists once, with the sum of its counts."""
    rows, out = table.to_pylist(), []
    for name in sorted({r["model"] for r in rows}):
        parts = []
        for r in rows:
            if r["model"] == name:
                a, b = _unpacked(r["grams"])
                parts.append((a, b, np.ones(len(a), np.int64) if r["n"] is None else _unpack(r["n"], "<u4").astype(np.int64)))
        a, b, n = _merged(parts)
        alike = pa.array(np.zeros(len(a), np.int64))
        out.append(pa.Table.from_arrays([table.column("shard").take(alike), pa.array([name]).take(alike), pa.array(a), pa.array(b), pa.array(n)], ["shard", "language", "a", "b", "n"]))
    return pa.concat_tables(out)


def _sums(lists: DataFrame) -> DataFrame:
    return lists.select("shard", "model", "grams", "n").groupBy("shard").applyInArrow(T.tidy_group(_summed), "shard long, language string, a long, b long, n long")


def _counts(texts: DataFrame, named: DataFrame, rest: bool) -> tuple[DataFrame, DataFrame]:
    """``language, a, b, n`` of the texts that ``named`` (``block, place, model``) names, and ``language, gram, n`` of their classes.

    With ``rest`` both also over all languages; model ``?`` counts there alone.
    """
    own = materialise(_sums(_lists(texts, named, _shards(texts), True)).drop("shard"), "gram-counts")
    both = own.where("language <> '?'")
    if rest:
        sums = own.groupBy(F.lit(ANY).alias("language"), "a", "b").agg(F.sum("n").alias("n"))
        both = materialise(both.unionByName(sums), "gram-counts")
    classes = F.col("a") == OF_CLASSES
    return both.where(~classes), both.where(classes).select("language", F.col("b").alias("gram"), "n")


def _context(length: int) -> tuple[Column, Column]:
    """``a`` and ``b`` of an n-gram of that length without its last character."""
    b = F.shiftright("b", CHAR_BITS)
    moved = F.shiftleft(F.col("a").bitwiseAND((1 << CHAR_BITS) - 1), 2 * CHAR_BITS)
    return F.shiftright("a", CHAR_BITS), b.bitwiseOR(moved) if length > 3 else b


def _shorter(length: int) -> tuple[Column, Column]:
    """``a`` and ``b`` of an n-gram of that length without its first character."""
    a, b = F.col("a"), F.col("b")
    if length > 3:
        return a.bitwiseAND((1 << CHAR_BITS * (length - 4)) - 1), b
    return F.lit(0).cast("long"), b.bitwiseAND((1 << CHAR_BITS * (length - 1)) - 1)


def levels_of(counts: DataFrame) -> list[DataFrame]:
    """``language, a, b, n, taken`` for each length from 1 on; lengths below the highest count the characters that stood before."""
    levels = [counts]
    for length in range(LENGTH, 1, -1):
        a, b = _shorter(length)
        levels.insert(0, materialise(levels[0].groupBy("language", a.alias("a"), b.alias("b")).agg(F.count("*").alias("n")), "gram-counts"))
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return [x.join(materialise(discounts(x), "discounts"), "language").select("language", "a", "b", "n", taken.alias("taken")) for x in levels]


def shares(levels: list[DataFrame], asked: DataFrame) -> DataFrame:
    """``asked`` (distinct ``language, a, b``) with ``own`` and ``rest``: the n-gram's probability is ``own + rest * that of its class``.

    Counts and the n-grams asked for meet by language and context, once a level; each level's answer joins its shorter form's.
    ``rest`` depends on the context alone. Other columns of ``asked`` stay.
    """
    wanted = [asked]
    for length in range(LENGTH, 1, -1):
        a, b = _shorter(length)
        wanted.insert(0, wanted[0].select("language", a.alias("a"), b.alias("b")).distinct())
    out = None
    for length, (level, rows) in enumerate(zip(levels, wanted), 1):
        both = level.withColumn("asked", F.lit(False)).unionByName(rows.withColumn("asked", F.lit(True)), allowMissingColumns=True)
        context = ["language", "context_a", "context_b"]
        for name, part in zip(context[1:], _context(length)):
            both = both.withColumn(name, part)
        near, same = Window.partitionBy(*context), Window.partitionBy(*context, "a", "b")
        met = both.select(
            *rows.columns, "asked",
            F.sum("n").over(near).alias("total"), F.sum("taken").over(near).alias("taken_all"), F.max(F.col("n") - F.col("taken")).over(same).alias("left"),
        ).where("asked")
        own, rest = F.coalesce(F.col("left") / F.col("total"), F.lit(0.0)), F.coalesce(F.col("taken_all") / F.col("total"), F.lit(1.0))
        now = met.select(*rows.columns, own.alias("own"), rest.alias("rest"))
        if out is not None:
            a, b = _shorter(length)
            lower = out.select("language", F.col("a").alias("short_a"), F.col("b").alias("short_b"), F.col("own").alias("low_own"), F.col("rest").alias("low_rest"))
            now = now.withColumns({"short_a": a, "short_b": b}).join(lower, ["language", "short_a", "short_b"])
            now = now.select(*rows.columns, (F.col("own") + F.col("rest") * F.col("low_own")).alias("own"), (F.col("rest") * F.col("low_rest")).alias("rest"))
        out = materialise(now, "gram-shares") if length < LENGTH else now
    return out


def discounts(counts: DataFrame) -> DataFrame:
    """``language, d1, d2, d3`` from how many n-grams were counted one to four times."""
    of = lambda k: F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double")
    rows = counts.groupBy("language").agg(*(of(k).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(k: int) -> Column:
        value = k - F.try_divide((k + 1) * y * F.col(f"n{k + 1}"), F.col(f"n{k}"))
        # Small samples may lack some counts: half of the count is taken off then.
        usable = (F.col("n1") > 0) & (F.col(f"n{k}") > 0) & (value > 0)
        return F.when(usable, F.least(value, F.lit(float(k)))).otherwise(F.lit(k / 2)).alias(f"d{k}")

    return rows.select("language", *(discount(k) for k in (1, 2, 3)))


def probabilities(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each length from 1 on, ``language, gram, p`` of seen n-grams and ``language, context, back`` of seen contexts.

    Lengths below the highest are counted by how many different characters stood before the n-gram.
    """
    levels = [counts]
    for length in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << (BITS * length)) - 1)
        levels.insert(0, materialise(levels[0].groupBy("language", shorter.alias("gram")).agg(F.count("*").alias("n")), "gram-counts"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for length, level in enumerate(levels, 1):
        context = F.shiftright("gram", BITS)
        taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = level.join(F.broadcast(discounts(level)), "language").select("language", "gram", context.alias("context"), "n", taken.alias("taken"))
        totals = rows.groupBy("language", "context").agg(F.sum("n").alias("total"), F.sum("taken").alias("taken_all"))
        back = totals.select("language", "context", (F.col("taken_all") / F.col("total")).alias("back"))
        met = rows.join(totals, ["language", "context"])
        own, share = (F.col("n") - F.col("taken")) / F.col("total"), F.col("taken_all") / F.col("total")
        if length == 1:
            seen = met.select("language", "gram", (own + share / CLASSES).alias("p"))
        else:
            lower = out[-1][0].select("language", F.col("gram").alias("shorter"), F.col("p").alias("lower"))
            met = met.withColumn("shorter", F.col("gram").bitwiseAND((1 << (BITS * (length - 1))) - 1))
            seen = met.join(lower, ["language", "shorter"]).select("language", "gram", (own + share * F.col("lower")).alias("p"))
        out.append((materialise(seen, "gram-probabilities"), back))
    return out


def _tables(counts: DataFrame) -> dict[str, np.ndarray]:
    """Log probability of every n-gram by language; unseen ones back off through their contexts."""
    tables: dict[str, np.ndarray] = {}
    for length, (seen, back) in enumerate(probabilities(counts), 1):
        rows, contexts = seen.toPandas(), back.toPandas()
        for name in sorted(contexts["language"].unique()):
            lower = tables[name] if length > 1 else np.full(1, 1 / CLASSES)
            weight = np.ones(CLASSES ** (length - 1))
            own = contexts[contexts["language"] == name]
            weight[own["context"]] = own["back"]
            gram = np.arange(CLASSES**length)
            table = weight[gram >> BITS] * lower[gram & (len(lower) - 1)]
            own = rows[rows["language"] == name]
            table[own["gram"]] = own["p"]
            tables[name] = table
    return {name: np.log(table).astype(np.float32) for name, table in tables.items()}


def _answer(left: pa.Table, right: pa.Table) -> pa.Table:
    """What a shard sends back to the blocks: their n-grams, each one's own share and each context's rest."""
    known, rows = {}, []
    for r in left.to_pylist():
        if r["model"] not in known:
            own = right.filter(pc.equal(right.column("language"), r["model"]))
            a, b, share, rest = (own.column(c).to_numpy() for c in ("a", "b", "own", "rest"))
            key = _mixed(a, b)
            order = np.argsort(key)
            known[r["model"]] = key[order], share[order], rest[order]
        key, share, rest = known[r["model"]]
        a, b = _unpacked(r["grams"])
        place = np.searchsorted(key, _mixed(a, b))
        rows.append((r["block"], r["model"], r["grams"], _pack(share[place].astype("<f4")), _pack(rest[place[_heads(a, b)]].astype("<f4"))))
    T.give_back()
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["block", "model", "grams", "own", "rest"])


def _characters(table: np.ndarray) -> np.ndarray:
    """Probability of a single character of each class after its context, from log probabilities of the classes."""
    each = np.exp(table.astype(float)).reshape(-1, CLASSES)
    # No character has class 0.
    return (each / (1 - each[:, :1]) / _SIZE).reshape(-1)


@dataclass(frozen=True)
class PerplexityFilter:
    """Counts of every level, a table of classes and two bounds of perplexity for each language."""

    tables: dict[str, np.ndarray] = field(repr=False)
    bounds: dict[str, tuple[float, float]]
    levels: list[DataFrame] = field(default_factory=list, repr=False)

    @staticmethod
    def fit(docs: DataFrame, labels: DataFrame) -> PerplexityFilter:
        """Counts and bounds over all trusted documents, whole texts; without any, nothing is rejected but empty texts.

        ``docs`` may be blocks that ``stored`` has written.
        """
        texts = _blocks(docs)
        trusted, own = _trusted(texts, labels)
        model = F.when(F.col("code").isin(own), F.col("code"))
        fitted = _trained(texts, trusted.select("block", "place", F.coalesce(model, F.lit("?")).alias("model")), True)
        if not fitted.tables:
            return PerplexityFilter({ANY: np.full(CLASSES**ORDER, -np.log(CLASSES), np.float32)}, {ANY: (0.0, float("inf"))})
        both = F.explode(F.array_distinct(F.array(F.coalesce(model, F.lit(ANY)), F.lit(ANY)))).alias("model")
        return fitted.bounded(materialise(fitted.score(texts, trusted.select("block", "place", both)), "trusted-scores"))

    def bounded(self, scored: DataFrame) -> PerplexityFilter:
        """With bounds from the ``perplexity`` of trusted documents under each ``model``."""
        found = order_statistics(scored.select(F.col("model").alias("group"), F.col("perplexity").alias("value")), [LOW, HIGH])
        bounds = {name: (low / SLACK, high * SLACK) for name, (n, (low, high)) in found.items() if n >= LEAST_DOCUMENTS or name == ANY}
        bounds.setdefault(ANY, (0.0, float("inf")))
        return PerplexityFilter({k: v for k, v in self.tables.items() if k in bounds}, bounds, self.levels)

    def score(self, texts: DataFrame, named: DataFrame) -> DataFrame:
        """``doc_id, block, place, model, n_chars_scored, perplexity`` (null for empty texts) of the documents in ``named`` (``block, place, model``)."""
        named = materialise(named, "named")
        replies = named.selectExpr("*", "binary(NULL) AS grams", "binary(NULL) AS own", "binary(NULL) AS rest")
        if self.levels:
            asked = materialise_buckets(_lists(texts, named, _shards(texts), False).repartition("shard"), "asked", "shard")
            grams = materialise(_sums(asked).drop("n"), "asked-once")
            met = shares(self.levels, grams).withColumns({c: F.col(c).cast("float") for c in ("own", "rest")}).groupBy(F.col("shard").alias("in_shard"))
            answers = asked.select("shard", "block", "model", "grams").groupBy("shard").cogroup(met)
            answers = answers.applyInArrow(_answer, "block long, model string, grams binary, own binary, rest binary")
            replies = replies.unionByName(answers, allowMissingColumns=True)
        # A broadcast is read once by each worker, a closure by each task.
        shared = texts.sparkSession.sparkContext.broadcast(self.tables)

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            found: list[tuple] = []
            if left.num_rows and right.num_rows:
                rows, row = right.filter(pc.is_valid(right.column("grams"))).to_pylist(), left.to_pylist()[0]
                known, bases = {}, {}
                for name in {r["model"] for r in rows}:
                    mine = [r for r in rows if r["model"] == name]
                    lists = [_unpacked(r["grams"]) for r in mine]
                    key = np.concatenate([_mixed(a, b) for a, b in lists])
                    own = np.concatenate([_unpack(r["own"], "<f4") for r in mine])
                    rest = np.concatenate([_unpack(r["rest"], "<f4")[np.cumsum(_heads(a, b)) - 1] for r, (a, b) in zip(mine, lists)])
                    order = np.argsort(key)
                    known[name] = [key[order], own[order].astype(float), rest[order].astype(float)]
                    del lists, key, own, rest, order
                for name, place, raw, at in _opened(row, *_named(right.filter(pc.is_valid(right.column("place"))))):
                    grams, ends = _grams(raw, at)
                    if name not in bases:
                        bases = {name: _characters(shared.value[name])}
                    each = bases[name][grams]
                    del grams
                    if name in known:
                        a, b, of = _distinct(raw, at)
                        key, own, rest = known[name]
                        at_key = np.searchsorted(key, _mixed(a, b))
                        each *= rest[at_key][of]
                        each += own[at_key][of]
                        del of
                    sums = np.zeros(len(each) + 1)
                    np.cumsum(np.log(each, out=each), out=sums[1:])
                    n = np.diff(ends)
                    value = np.exp(-(sums[ends[1:]] - sums[ends[:-1]]) / np.maximum(n, 1))
                    found.append((place, [name] * len(place), n, np.where(n > 0, value, np.nan)))
            T.give_back()
            place, n, value = (np.concatenate([np.zeros(0, t), *(f[k] for f in found)]) for k, t in ((0, np.int64), (2, np.int64), (3, float)))
            ids = pa.array(row["doc_id"], pa.int64()).take(pa.array(place.astype(np.int64))) if found else pa.array([], pa.int64())
            place = pa.array(place.astype(np.int32))
            return pa.Table.from_arrays(
                [ids, left.column("block").take(pa.array(np.zeros(len(place), np.int64))), place, pa.array([x for f in found for x in f[1]], pa.string()), pa.array(n), pa.array(value, mask=n == 0)], ["doc_id", "block", "place", "model", "n_chars_scored", "perplexity"]
            )

        met = texts.select("block", "doc_id", "lengths", "texts").groupBy("block").cogroup(replies.groupBy(F.col("block").alias("for_block")))
        return met.applyInArrow(score, "doc_id long, block long, place int, model string, n_chars_scored long, perplexity double")

    def classify(self, docs: DataFrame) -> DataFrame:
        """``doc_id, model, n_chars_scored, perplexity, low, high, kept`` for every row of ``docs`` (``doc_id, text, lang``, or what ``stored`` made of them).

        ``low`` and ``high`` are the bounds of the language, wider the shorter the text.
        A null or unknown language is judged by the model of all. Null and empty texts have no perplexity
        and are not kept. Repeated rows are judged alike; other columns are not read.
        """
        texts = _blocks(docs)
        model = F.when(F.col("code").isin(sorted(self.tables)), F.col("code")).otherwise(F.lit(ANY))
        return self.judged(self.score(texts, _places(texts).select("block", "place", model.alias("model"))))

    def judged(self, scored: DataFrame) -> DataFrame:
        """Verdicts of what ``score`` returns."""
        entries = [x for name, (low, high) in sorted(self.bounds.items()) for x in (F.lit(name), F.array(F.lit(low), F.lit(high)))]
        bound = F.element_at(F.create_map(*entries), F.col("model"))
        stray = F.exp(F.lit(SPREAD) / F.sqrt(F.greatest("n_chars_scored", F.lit(1))))
        out = scored.withColumns({"low": F.element_at(bound, 1) / stray, "high": F.element_at(bound, 2) * stray})
        kept = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(False))
        return out.select("doc_id", "model", "n_chars_scored", "perplexity", "low", "high", kept.alias("kept"))


def _blocks(docs: DataFrame) -> DataFrame:
    return docs if docs.columns == STORED else stored(docs)


def _trusted(texts: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """``block, place, code`` of trusted documents, and the languages that get a model of their own."""
    ids = trusted_ids(labels.select("doc_id", "quality", "toxic"))
    trusted = materialise(_places(texts).join(ids, "doc_id").select("block", "place", "code"), "trusted-places")
    held = trusted.where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_DOCUMENTS)
    return trusted, [r["code"] for r in held.orderBy(F.desc("n"), "code").limit(MOST_LANGUAGES).collect()]


def _trained(texts: DataFrame, named: DataFrame, rest: bool) -> PerplexityFilter:
    """Counts of the documents in ``named``, without bounds."""
    counts, classes = _counts(texts, named, rest)
    tables = _tables(classes)
    return PerplexityFilter(tables, {}, levels_of(counts) if tables else [])


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The same rows as ``PerplexityFilter.fit(docs, labels).classify(docs)``.

    Where every document's language has a model, all are scored once, and the bounds come from the trusted ones among them.
    """
    texts = _blocks(docs)
    trusted, own = _trusted(texts, labels)
    places = _places(texts)
    if not places.where(~F.coalesce(F.col("code").isin(own), F.lit(False))).isEmpty():
        return PerplexityFilter.fit(texts, labels).classify(texts)
    model = _trained(texts, trusted.select("block", "place", F.col("code").alias("model")), False)
    scored = materialise(model.score(texts, places.select("block", "place", F.col("code").alias("model"))), "scores")
    # As many rows as there are trusted documents, which a small enough file would have Spark broadcast.
    fitted = model.bounded(materialise(scored.join(trusted.select("block", "place").hint("merge"), ["block", "place"]).select("model", "perplexity"), "trusted-scores"))
    if set(fitted.tables) < set(own):  # too few texts that are not empty: the model of all judges that language
        return PerplexityFilter.fit(texts, labels).classify(texts)
    return fitted.judged(scored)

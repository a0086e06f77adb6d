"""Language identification: interpolated Kneser-Ney character models, one per language.

All learning documents' character 5-grams are counted by language over the cluster, and all of them enter
the models. Up to `MOST` of them make one broadcast model; more are cut into shards of about that size by the two
letters before the last, which an n-gram shares with all it backs off to and their contexts. Shards are
built, broadcast, searched by all texts and released one after another, and their sums added; only discounts and the
n-grams of one and two letters are counted over all shards. Shards and one model give the same results. From the counts
the driver derives the orders below (their counts are the numbers of different left neighbours), the
discounts, and for every n-gram seen in any language the interpolated probability in each language;
n-grams lie in sorted arrays of their hashes, with the contexts' back-off weights beside them. A text
gets the language with the lowest cross-entropy per character. The score is the best language's
calibrated share; a text whose cross-entropy is above what the language's own documents show is marked
`rejected`, its language is given all the same. Calibration scores all learning documents, whatever
their length; the driver gets one row of sums a language. Where the learning documents are among those to be judged
(`fit_and_identify`), a text's cross-entropies are computed once, stored, and serve both.

Null texts and texts without a letter get `und` with score 0. Every row is judged by its text alone,
so repeated rows, ties and null ids change nothing; equal cross-entropies go to the smaller language
name. Without learning rows every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, read
from .learn import remainder

#: Order; bits of a character code; 5-grams of four languages that are broadcast at once (a shard stays near 40 bytes *
#: 5 * MOST for any number of languages, or the size of the largest pair of letters' n-grams); documents that `calibration_rows` shows; rows a task gathers before it hands counts on;
#: characters handled at once (each takes about a hundred bytes for a moment).
ORDER, BITS, MOST, CALIBRATE, HELD, AT_ONCE = 5, 12, 1_500_000, 2_000, 1_000_000, 500_000
UNKNOWN = "und"
NOTHING = {"lang": UNKNOWN, "score": 0.0, "entropy": None, "rejected": True}


def _codes() -> np.ndarray:
    """Character code of each code point below 65,536: 0 for all but letters, else the lower-case letter, folded to 12 bits."""
    low = np.zeros(1 << 16, np.int64)
    for c in range(1 << 16):
        if chr(c).isalpha():
            o = ord(chr(c).lower()[0])
            low[c] = o if o < 2048 else 2048 + o % 2048
    return low


_TABLE = _codes()


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(packed 5-grams ending at each character, document number). Characters other than letters count as one blank
    between words; before a document stand blanks."""
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t or "") for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    code = np.where(points < 1 << 16, _TABLE[np.minimum(points, (1 << 16) - 1)], 2048 + points.astype(np.int64) % 2048)
    head = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    keep = (code != 0) | (~head & np.concatenate([[0], code[:-1]]).astype(bool)) if len(code) else np.zeros(0, bool)
    code, doc = code[keep], doc[keep]
    if not len(code):
        return code, doc
    start = np.searchsorted(doc, np.arange(len(texts)))
    place = np.arange(len(doc)) - start[doc]
    packed = code.copy()
    for j in range(1, ORDER):
        packed |= np.where(place >= j, np.concatenate([np.zeros(j, np.int64), code[:-j]])[:len(code)], 0) << (BITS * j)
    return packed, doc


def slices(texts: list[str | None], most: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together, or of one longer text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective hash of 64-bit numbers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hashed:
    """A sorted array of hashes with a row of values for each; the hash's first bits tell where to look."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        hashes = _mix(keys)
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], np.concatenate([values[order], np.zeros((1, values.shape[1]), np.float32)])
        self.shift = np.uint64(64 - max(4, min(20, int(len(keys)).bit_length())))
        self.begin = np.searchsorted(self.hashes >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)).astype(np.int32)
        self.steps = int(np.diff(self.begin).max()) if len(keys) else 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is missing."""
        hashes = _mix(keys)
        at = self.begin[(hashes >> self.shift).astype(np.int64)]
        padded = np.append(self.hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
        going = np.arange(len(keys))
        for _ in range(self.steps):
            going = going[padded[at[going]] < hashes[going]]
            if not len(going):
                break
            at[going] += 1
        return np.where((at < len(self.hashes)) & (padded[at] == hashes), at, -1)


def shard_of(gram, parts: int):
    """Shard of 5-grams (a numpy array, or a Spark column of longs), from the two letters before the last."""
    if isinstance(gram, F.Column):
        pair = F.shiftright(gram, BITS).bitwiseAND(F.lit((1 << 2 * BITS) - 1).cast("long"))
        return F.shiftright(pair * F.lit(2654435761), BITS) % parts
    return (((gram >> BITS) & ((1 << 2 * BITS) - 1)) * 2654435761 >> BITS) % parts


class Judge:
    """Languages, and what calibration adds to cross-entropies."""

    def __init__(self, languages: list[str]) -> None:
        self.languages = languages
        self.sharpness, self.limit = 1.0, np.full(len(languages), np.inf)

    def calibrate(self, scored: DataFrame) -> None:
        """The softmax sharpness with the best likelihood, and each language's largest usual cross-entropy, from all rows of
        scored (truth, entropies), a row a text that has letters and its cross-entropy in each language. One row a language comes back."""
        languages = F.array(*[F.lit(x) for x in self.languages])
        right = F.array_position(languages, F.col("truth")).cast("int")
        own = F.element_at("entropies", F.col("right"))
        least = F.array_min("entropies")
        steps = [0.5 * 1.5 ** i for i in range(12)]

        def loss(s: float) -> F.Column:
            z = F.aggregate("entropies", F.lit(0.0), lambda t, e: t + F.exp((e - F.col("least")) * -s))
            return F.sum(F.col("over") * s + F.log(z))

        rows = scored.withColumn("right", right).select("right", "entropies", own.alias("own"), least.alias("least"), (own - least).alias("over"))
        of = rows.groupBy("right").agg(F.count("*").alias("n"), F.avg("own").alias("mean"), F.stddev_pop("own").alias("spread"),
                                       *[loss(s).alias(f"s{i}") for i, s in enumerate(steps)]).collect()
        if not of:
            return
        total = [sum(r[f"s{i}"] for r in of) for i in range(len(steps))]
        self.sharpness = steps[int(np.argmin(total))]
        for r in of:
            if r["n"] > 1:
                self.limit[r["right"] - 1] = r["mean"] + 6 * r["spread"] + 0.1

    def verdicts(self, entropy: np.ndarray, sizes: np.ndarray) -> list[dict]:
        if not self.languages:
            return [NOTHING] * len(sizes)
        best = entropy.argmin(1)
        share = np.exp(-self.sharpness * (entropy - entropy.min(1, keepdims=True)))
        score = 1 / share.sum(1)
        out = []
        for i, b in enumerate(best.tolist()):
            if not sizes[i]:
                out.append(NOTHING)
            else:
                out.append({"lang": self.languages[b], "score": float(score[i]), "entropy": float(entropy[i, b]), "rejected": bool(entropy[i, b] > self.limit[b])})
        return out


class Short(NamedTuple):
    """What a shard shares with all others: each order's discount, and (lang, gram, count) of orders 1 and 2."""

    discounts: dict[int, float]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class Models(Judge):
    """Kneser-Ney models of several languages over the union of their n-grams, or over one shard of it."""

    def __init__(self, languages: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray, short: Short | None = None) -> None:
        super().__init__(languages)
        k = len(languages)
        types, weight = [(lang, gram)], [count.astype(float)]
        for n in range(ORDER - 1, 0, -1):  # a shorter n-gram counts its different left neighbours
            if short and n in short.grams:
                types.append(short.grams[n][:2])
                weight.append(short.grams[n][2].astype(float))
                continue
            own_lang, own = types[-1][0], types[-1][1] & ((1 << (BITS * n)) - 1)
            order = np.lexsort((own, own_lang))
            own_lang, own = own_lang[order], own[order]
            new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (own_lang[1:] != own_lang[:-1]))) if len(own) else np.zeros(0, bool))
            types.append((own_lang[new], own[new]))
            weight.append(np.diff(np.append(new, len(own))).astype(float))
        self.grams: list[Hashed] = []
        self.backs: list[Hashed] = []
        lower: np.ndarray | None = None
        for n in range(1, ORDER + 1):
            (own_lang, own), own_count = types[ORDER - n], weight[ORDER - n]
            union, at = np.unique(own, return_inverse=True)
            contexts, context_at = np.unique(union >> BITS, return_inverse=True)
            discount = short.discounts[n] if short else _discount((own_count == 1).sum(), (own_count == 2).sum())
            shorter_at = np.searchsorted(shorter, union & ((1 << (BITS * (n - 1))) - 1)) if n > 1 else None
            prob, gamma = np.empty((len(union), k), np.float32), np.empty((len(contexts), k), np.float32)
            for j in range(k):  # one language at a time: the arrays of all together would be the driver's largest
                mine = own_lang == j
                own_at = at[mine]
                counts = np.zeros(len(union))
                counts[own_at] = own_count[mine]
                total = np.bincount(context_at, counts, len(contexts))
                kinds = np.bincount(context_at[own_at], minlength=len(contexts))
                gamma[:, j] = np.where(total > 0, discount * kinds / np.maximum(total, 1e-9), 1.0)
                below = lower[shorter_at, j] if n > 1 else np.float32(1.0 / (1 << BITS))
                prob[:, j] = np.maximum(counts - discount, 0) / np.maximum(total, 1e-9)[context_at] + gamma[context_at, j] * below
            types[ORDER - n] = weight[ORDER - n] = None
            self.grams.append(Hashed(union, np.log(prob)))
            self.backs.append(Hashed(contexts, np.log(gamma)))
            lower, shorter = prob, union
        self.floor = np.float32(-BITS * np.log(2))

    def log_probs(self, packed: np.ndarray) -> np.ndarray:
        """Log probability of each character in each language, given the four before it."""
        out = np.zeros((len(packed), len(self.languages)), np.float32)
        left = np.arange(len(packed))
        for n in range(ORDER, 0, -1):
            part = packed[left] & ((1 << (BITS * n)) - 1)
            at = self.grams[n - 1].find(part)
            hit = at >= 0
            out[left[hit]] += self.grams[n - 1].values[at[hit]]
            left, part = left[~hit], part[~hit]
            if not len(left):
                return out
            out[left] += self.backs[n - 1].values[self.backs[n - 1].find(part >> BITS)]  # an unknown context adds 0
        out[left] += self.floor
        return out

    def sums(self, texts: list[str | None], part: int = 0, parts: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text's characters that are this shard's in each language, and the number of
        characters of all shards (0: no letter)."""
        found = [self._sums(texts[a:b], part, parts) for a, b in slices(texts)]
        if not found:
            return np.zeros((0, len(self.languages))), np.zeros(0, int)
        return np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])

    def _sums(self, texts: list[str | None], part: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        packed, doc = grams(texts)
        sizes = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), int)
        if parts > 1 and len(packed):
            mine = shard_of(packed, parts) == part
            packed, doc = packed[mine], doc[mine]
        known, back = np.unique(packed, return_inverse=True) if len(packed) else (packed, packed)
        logs = self.log_probs(known)
        sums = np.column_stack([np.bincount(doc, logs[back, j], len(texts)) for j in range(len(self.languages))]) if len(doc) else np.zeros((len(texts), len(self.languages)))
        return sums, sizes

    def judge(self, texts: list[str | None]) -> list[dict]:
        if not self.languages:
            return [NOTHING] * len(texts)
        sums, sizes = self.sums(texts)
        return self.verdicts(entropies(sums, sizes), sizes)


def entropies(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cross-entropy per character in each language."""
    return -sums / np.maximum(sizes, 1)[:, None]


def _collected(counted: DataFrame, languages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, gram, count), ordered."""
    number = F.array_position(F.array(*[F.lit(x) for x in languages]).cast("array<string>"), F.col("lang")) - 1
    table = counted.select(number.cast("long").alias("lang"), "gram", "count").toArrow()  # columns of numbers, never a row object for each
    lang, gram, count = (table.column(c).to_numpy() for c in ("lang", "gram", "count"))
    order = np.lexsort((gram, lang))
    return lang[order], gram[order], count[order]


class Sharded(Judge):
    """Models of more n-grams than are broadcast at once; the counts stay in a table, ordered by shard."""

    def __init__(self, languages: list[str], counted: DataFrame, parts: int) -> None:
        from .common import cut, partitions

        super().__init__(languages)
        self.parts = parts
        discounts, short, shorter = {}, {}, counted
        for n in range(ORDER, 0, -1):
            if n < ORDER:
                shorter = cut(shorter.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << BITS * n) - 1).cast("long")).alias("gram")).agg(F.count("*").alias("count")))
            discounts[n] = _discount(*shorter.agg(F.count_if(F.col("count") == 1), F.count_if(F.col("count") == 2)).first())
            if n <= 2:
                short[n] = _collected(shorter, languages)
        self.short = Short(discounts, short)
        spark = counted.sparkSession
        self.counted = cut(counted.withColumn("shard", shard_of(F.col("gram"), parts)).repartition(max(partitions(spark), parts), "shard", "gram").sortWithinPartitions("shard"))

    def shards(self) -> Iterator[tuple[int, Models]]:
        for part in range(self.parts):
            yield part, Models(self.languages, *_collected(self.counted.where(F.col("shard") == part), self.languages), self.short)


def count_grams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, gram, count) over all rows with a language; tasks sum what they have read before handing it on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows = 0

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            parts = held[lang]
            keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(back, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang in held:
                keys, sums = merged(lang)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(sums, pa.int64())], names=["lang", "gram", "count"])
            held.clear()

        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                packed, doc = grams(texts[a:b])
                names = sorted(set(langs[a:b]))
                number = np.array([names.index(x) for x in langs[a:b]])
                for j, lang in enumerate(names):
                    keys, sums = np.unique(packed[number[doc] == j], return_counts=True)
                    held.setdefault(lang, []).append((keys, sums))
                    rows += len(keys)
            if rows > HELD:
                for lang in held:
                    held[lang] = [merged(lang)]
                rows = sum(len(p[0][0]) for p in held.values())
                if rows > HELD:
                    yield from out()
                    rows = 0
        yield from out()

    use = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return use.mapInArrow(run, "lang string, gram long, count long").groupBy("lang", "gram").agg(F.sum("count").alias("count"))


def _uncalibrated(use: DataFrame, most: int) -> Models | Sharded:
    from .common import cut

    counted = cut(count_grams(use))
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    parts = -(-counted.count() * (1 + len(languages)) // (5 * most))
    return Models(languages, *_collected(counted, languages)) if parts <= 1 else Sharded(languages, counted, parts)


def _learning(docs: DataFrame, train: F.Column) -> DataFrame:
    return docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())


def fit(docs: DataFrame, train: F.Column, most: int = MOST) -> Models | Sharded:
    from .common import cut

    use = _learning(docs, train)
    models = _uncalibrated(use, most)
    if models.languages:
        models.calibrate(cut(scored_rows(use, models)))
    return models


def fit_and_identify(docs: DataFrame, train: F.Column, most: int = MOST, out: str = "language") -> DataFrame:
    """docs without their texts, with the struct `out` that `identify` gives by the models that `fit` learns from the rows of train.
    Every text is scored once: the stored cross-entropies calibrate the models and are judged then."""
    from .common import cut

    models = _uncalibrated(_learning(docs, train), most)
    scored = cut(_entropies_of(docs.withColumn("_learn", train & F.col("lang").isNotNull()), models))
    judge = Judge(models.languages)
    if judge.languages:
        judge.calibrate(scored.where(F.col("_learn") & F.col("_entropies").isNotNull()).select(F.col("lang").cast("string").alias("truth"), F.col("_entropies").alias("entropies")))

    def run(rows: pa.Array) -> pa.Array:
        has = rows.is_valid().to_numpy(zero_copy_only=False)
        entropy = np.zeros((len(rows), len(judge.languages)))
        entropy[has] = rows.flatten().to_numpy().reshape(-1, len(judge.languages)) if has.any() else 0
        return pa.array(judge.verdicts(entropy, has), _RESULT)

    return append_column(scored.drop("_learn"), out, RESULT, "_entropies", run).drop("_entropies")


def _entropies_of(docs: DataFrame, models: Models | Sharded) -> DataFrame:
    """docs without their texts, with the cross-entropy of each text in each language; null without a letter or a language."""
    kind, width = T.ArrayType(T.DoubleType()), len(models.languages)

    def listed(sums: np.ndarray, sizes: np.ndarray) -> pa.Array:
        found = entropies(sums, sizes)
        return pa.array([e if n else None for e, n in zip(found, sizes, strict=True)], pa.list_(pa.float64()))

    if not width:
        return docs.drop("text").withColumn("_entropies", F.lit(None).cast(kind))
    if isinstance(models, Sharded):
        summed = _sums_by_shards(docs, models, "text")
        both = docs.withColumn("_key", F.md5("text")).drop("text").join(summed, F.col("_key") == F.col("key"), "left").withColumn(
            "_both", F.when(F.col("key").isNotNull(), F.struct("sums", "size"))).drop("_key", "key", "sums", "size")

        def add(rows: pa.Array) -> pa.Array:
            has = np.flatnonzero(rows.is_valid().to_numpy(zero_copy_only=False))
            sums, sizes = np.zeros((len(rows), width)), np.zeros(len(rows), np.int64)
            known = rows.take(pa.array(has))
            sums[has], sizes[has] = _added(known.field("sums"), width), known.field("size").to_numpy()
            return listed(sums, sizes)

        return append_column(both, "_entropies", kind, "_both", add).drop("_both")
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by MOST
    return append_column(docs, "_entropies", kind, "text", lambda texts: listed(*shared.value.sums(texts.to_pylist()))).drop("text")


def scored_rows(use: DataFrame, models: Models | Sharded) -> DataFrame:
    """(truth, entropies) of every text that has letters: what calibration learns from, none left out."""
    texts = use.select(F.col("lang").cast("string").alias("truth"), F.col("text"))
    schema = "truth string, entropies array<double>"

    def rows(truth: pa.Array, sums: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        has = np.flatnonzero(sizes)
        return pa.RecordBatch.from_arrays([truth.take(pa.array(has)), pa.array(list(entropies(sums[has], sizes[has])), pa.list_(pa.float64()))], names=["truth", "entropies"])

    if isinstance(models, Sharded):
        summed = _sums_by_shards(texts, models, "text")
        of = texts.select("truth", F.md5("text").alias("_key")).join(summed, F.col("_key") == F.col("key")).select("truth", "sums", "size")

        width = len(models.languages)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rows(batch.column(0), _added(batch.column(1), width), batch.column(2).to_numpy())

        return of.mapInArrow(add, schema)
    shared = use.sparkSession.sparkContext.broadcast(models)  # bounded by MOST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rows(batch.column(0), *shared.value.sums(batch.column(1).to_pylist()))

    return texts.mapInArrow(run, schema)


def calibration_rows(use: DataFrame, languages: list[str], most: int = CALIBRATE) -> list:
    """(lang, text) of the `most` ids with the smallest hashes, for looking at by hand; no model is fitted or calibrated on them. Tasks offer ids
    alone; the texts, at most 20,000 characters each, follow for the ids that were chosen. Rows that repeat an id count as the one with the smallest language and text."""
    short = use.where(F.col("lang").isin(languages) & (F.length("text") <= 20_000)).select("doc_id", F.col("lang").cast("string"), "text")
    ids = short.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    one = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row"))
    return [r["row"] for r in one.orderBy("doc_id").collect()]


RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


_RESULT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("entropy", pa.float64()), ("rejected", pa.bool_())])


def identify(docs: DataFrame, models: Models | Sharded, text_col: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct `out`: lang, score, entropy (nats a character), rejected."""
    if isinstance(models, Sharded):
        return _identify_by_shards(docs, models, text_col, out)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by MOST

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.judge(texts.to_pylist()), _RESULT)

    return append_column(docs, out, RESULT, text_col, run)


def _added(parts: pa.Array, width: int) -> np.ndarray:
    """The sums of all shards of each text, added in the order of the shards."""
    return np.array([np.sum([p["sums"] for p in row], axis=0) for row in parts.to_pylist()]).reshape(-1, width)


def _sums_by_shards(docs: DataFrame, models: Sharded, text_col: str) -> DataFrame:
    """(key, sums, size) of each different text. A pass over the texts for each shard, its sums written before the next shard is built."""
    from .common import cut

    spark, parts = docs.sparkSession, models.parts
    texts = docs.select(F.md5(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull())
    answers = None
    for part, shard in models.shards():
        shared = spark.sparkContext.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch], part: int = part, shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums, sizes = shared.value.sums(batch.column(1).to_pylist(), part, parts)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(sums), pa.list_(pa.float64())), pa.array(sizes, pa.int64())], names=["key", "sums", "size"])

        own = cut(texts.mapInArrow(run, "key string, sums array<double>, size long").groupBy("key").agg(F.first("sums").alias("sums"), F.first("size").alias("size"))
                  .withColumn("part", F.lit(part)))
        shared.destroy()
        answers = own if answers is None else answers.unionByName(own)
    return answers.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "sums"))).alias("sums"), F.first("size").alias("size"))


def _identify_by_shards(docs: DataFrame, models: Sharded, text_col: str, out: str) -> DataFrame:
    """The sums of all shards are added and judged once for each different text."""
    from .common import cut

    whole = _sums_by_shards(docs, models, text_col)
    judge = Judge(models.languages)
    judge.sharpness, judge.limit = models.sharpness, models.limit

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = _added(batch.column(1), len(judge.languages))
            sizes = batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(judge.verdicts(entropies(sums, sizes), sizes), _RESULT)], names=["_key", out])

    judged = cut(whole.mapInArrow(decide, T.StructType([T.StructField("_key", T.StringType()), T.StructField(out, RESULT)])))
    nothing = F.struct(*[F.lit(NOTHING[f.name]).cast(f.dataType).alias(f.name) for f in RESULT.fields])
    marked = docs.drop(out).withColumn("_key", F.md5(F.col(text_col))).join(judged, "_key", "left")
    return marked.select(*[F.col(c) for c in docs.drop(out).columns], F.coalesce(F.col(out), nothing).alias(out))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return fit_and_identify(docs, F.coalesce(remainder("doc_id", 5) != 0, F.lit(False))).select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))

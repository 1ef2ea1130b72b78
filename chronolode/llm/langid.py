"""Language identification with interpolated Kneser-Ney character language models.

Texts are folded to lower-case letters with single spaces between words. For each language the counts of ORDER-grams
of all learning documents are summed; Kneser-Ney's lower orders count in how many ways a shorter gram is continued, so
they follow from the distinct longest grams. Discounts, interpolated probabilities and back-off weights are computed
as tables on the executors, from every gram, and stored as one sorted array of 64-bit hashes, each with its run of
(language, log probability) and (language, log weight). A text's languages are compared by cross-entropy a character;
the lowest wins.

Rejection and the sharpness of the score are calibrated on all documents of a fold of the learning documents
(CALIBRATION_FOLD) by models that are counted without it; the models that predict count all learning documents.

Counting and scoring are one pass each, without a shuffle of texts: counts leave a task as one row for each distinct
gram and language. The tables are cut into shards of about SHARD entries by the two characters before the last one, on
which a gram and all its back-off steps agree (pairs and single characters are in every shard). The driver holds and
broadcasts one shard at a time; a model of more shards scores the documents in as many passes, which add up.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolode.llm import _grid
from chronolode.llm._session import checkpoint

ORDER = 4
CALIBRATION_FOLD = 1
CALIBRATION = 0.99
#: Ranges that a pass of quantiles() counts.
BINS = 256
#: Entries of a shard; one takes 14 bytes.
SHARD = 4_000_000
UNDETERMINED = "und"
_GROUP = 1 << 19
_PREDICT, _CALIBRATE = 0, 1
_letters: np.ndarray | None = None


def held_out(doc_id: Column) -> Column:
    """True for rows kept apart from learning: crc32 of the id as text is divisible by 5; a null id: false."""
    return F.coalesce(_fold(doc_id) == 0, F.lit(False))


def _fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def normalised(text: str | None) -> np.ndarray:
    """Code points of the folded text with ORDER - 1 spaces before it and one behind; empty if it has no letter."""
    if not text:
        return np.zeros(0, np.uint32)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[cp]
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    out = np.where(letter, cp, 32)[keep]
    return np.concatenate([np.full(ORDER - 1, 32, np.uint32), out, [32] if letter[-1] else []]).astype(np.uint32)


def _groups(texts: Iterator[str | None]) -> Iterator[list[np.ndarray]]:
    group, n = [], 0
    for t in texts:
        group.append(normalised(t))
        n += len(group[-1])
        if n >= _GROUP:
            yield group
            group, n = [], 0
    yield group


def _window_ids(cp: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of `order` code points, one a row, and each position's row."""
    alphabet = np.unique(cp)
    symbol = np.searchsorted(alphabet, cp).astype(np.uint64)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    n = len(cp) - order + 1
    key = symbol[:n].copy()
    if order * bits > 64:  # too many symbols to pack: number the distinct runs, one character longer each time
        for k in range(1, order):
            _, index, inverse = np.unique((key << np.uint64(32)) | symbol[k : k + n], return_index=True, return_inverse=True)
            key = inverse.astype(np.uint64)
        return cp[index[:, None] + np.arange(order)], inverse
    kind = np.uint32 if order * bits <= 32 else np.uint64
    symbol, key = symbol.astype(kind), key.astype(kind)
    for k in range(1, order):
        key = (key << kind(bits)) | symbol[k : k + n]
    distinct, inverse = np.unique(key, return_inverse=True)
    mask = kind((1 << bits) - 1)
    return np.stack([alphabet[(distinct >> kind(bits * (order - 1 - k))) & mask] for k in range(order)], axis=1), inverse


def _gram_hash(grams: np.ndarray) -> np.ndarray:
    """Of runs of code points, one a row."""
    h = np.full(len(grams), grams.shape[1], np.uint64)
    for k in range(grams.shape[1]):
        h = _grid.mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + grams[:, k].astype(np.uint64) + np.uint64(1))
    return h


@dataclass
class _Runs:
    """Sorted hashes, each with a run of (language, value)."""

    keys: np.ndarray
    first: np.ndarray
    language: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(h: np.ndarray, language: np.ndarray, value: np.ndarray) -> _Runs:
        rank = np.lexsort((language, h))
        keys, first = np.unique(h[rank], return_index=True)
        return _Runs(keys, np.append(first, len(h)), language[rank], value[rank])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in h, language, value) of every entry of the hashes."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == h)
        begin = self.first[at[hit]]
        n = self.first[at[hit] + 1] - begin
        entry = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(hit, n), self.language[entry], self.value[entry]


@dataclass
class _Shard:
    value: _Runs
    backoff: _Runs
    floor: np.ndarray  # log probability of a character that a language never had
    number: int
    of: int

    def gram_logs(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last character by language (rows); 0 for grams of other shards."""
        out = np.zeros((len(self.floor), len(grams)))
        mine = np.arange(len(grams)) if self.of == 1 else np.flatnonzero(_shard_of(grams[:, -3:-1], self.of) == self.number)
        g = grams[mine]
        logs, open_ = np.zeros((len(self.floor), len(g))), np.ones((len(self.floor), len(g)), bool)
        for order in range(ORDER, 0, -1):
            at, k, v = self.value.find(_gram_hash(g[:, ORDER - order :]))
            first = open_[k, at]
            logs[k[first], at[first]] += v[first]
            open_[k, at] = False
            if order > 1:
                at, k, v = self.backoff.find(_gram_hash(g[:, ORDER - order : -1]))
                still = open_[k, at]
                logs[k[still], at[still]] += v[still]
        out[:, mine] = logs + open_ * self.floor[:, None]
        return out

    def sums(self, group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Nats by document and language, and the number of characters."""
        size = np.array([max(0, len(x) - ORDER + 1) for x in group], np.int64)
        out = np.zeros((len(group), len(self.floor)))
        has = np.flatnonzero(size)
        if len(has) and len(self.floor):
            grams, inverse = _window_ids(np.concatenate([group[i] for i in has]), ORDER)
            begin = np.cumsum(size[has] + ORDER - 1) - size[has] - ORDER + 1
            logs = self.gram_logs(grams)
            # Sums over a document's own positions; those across documents lie between them.
            cut = np.stack([begin, np.minimum(begin + size[has], len(inverse))], axis=1).ravel()
            for k in range(len(self.floor)):
                out[has, k] = -np.add.reduceat(np.append(logs[k][inverse], 0.0), cut)[::2]
        return out, size


def _shard_of(pairs: np.ndarray, of: int) -> np.ndarray:
    return (_gram_hash(pairs) >> np.uint64(20)) % np.uint64(of)


def _count(docs: DataFrame, doc_id: str, lang: str, text: str) -> DataFrame:
    """(lang, apart, gram, n) over all learning rows; apart: of the calibration fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for language, apart in sorted(set(kinds)):
                rows = (t.as_py() for t, x in zip(batch.column(2), kinds, strict=True) if x == (language, apart))
                for group in _groups(rows):
                    parts = [x for x in group if len(x)]
                    if not parts:
                        continue
                    size = np.array([len(x) for x in parts])
                    grams, inverse = _window_ids(np.concatenate(parts), ORDER)
                    weight = np.ones(len(inverse), np.int64)
                    for k in range(1, ORDER):  # runs across two documents
                        ends = np.cumsum(size)[:-1] - k
                        weight[ends] = 0
                    n = np.bincount(inverse, weight, minlength=len(grams)).astype(np.int64)
                    some = n > 0
                    m = int(some.sum())
                    text_ = np.ascontiguousarray(grams[some].astype("<u4")).tobytes().decode("utf-32-le", "surrogatepass")
                    yield pa.record_batch([pa.array([language] * m, pa.string()), pa.array([apart] * m, pa.bool_()), pa.array([text_[i : i + ORDER] for i in range(0, len(text_), ORDER)], pa.string()), pa.array(n[some])], ["lang", "apart", "gram", "n"])

    fold = _fold(F.col(doc_id))
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.coalesce(fold == CALIBRATION_FOLD, F.lit(False)).alias("apart"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "lang string, apart boolean, gram string, n long").groupBy("lang", "apart", "gram").agg(F.sum("n").alias("n"))


def _discount(ones: int, twos: int) -> float:
    """Of one order: n1 / (n1 + 2 n2), kept within 0.1 and 0.95."""
    return min(0.95, max(0.1, ones / max(ones + 2 * twos, 1)))


def kneser_ney(counted: DataFrame) -> tuple[DataFrame, dict[int, dict[str, float]]]:
    """(set, lang, kind, gram, p): probabilities (kind v) and back-off weights by context (kind b) of counted(lang,
    apart, gram, n), for set 0 of all rows and set 1 without those apart; and by set and language the probability of
    a character that was never seen.

    Counts of all grams are used, whatever their number; the driver gets one row a set, language and order.
    """
    sets = F.explode(F.when(F.col("apart"), F.array(F.lit(_PREDICT))).otherwise(F.array(F.lit(_PREDICT), F.lit(_CALIBRATE)))).alias("set")
    key = ["set", "lang"]
    level = counted.select(sets, "lang", "gram", "n").groupBy(*key, "gram").agg(F.sum("n").cast("double").alias("c"))
    levels = {ORDER: checkpoint(level)}
    for order in range(ORDER - 1, 0, -1):  # continuation counts: distinct longer grams by their end
        levels[order] = checkpoint(levels[order + 1].groupBy(*key, F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).cast("double").alias("c")))
    facts = [F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("total"), F.sum(F.expr("int(c = 1)")).alias("ones"), F.sum(F.expr("int(c = 2)")).alias("twos")]
    every = levels[1].withColumn("order", F.lit(1))
    for order in range(2, ORDER + 1):
        every = every.unionByName(levels[order].withColumn("order", F.lit(order)))
    rows = every.groupBy(*key, "order").agg(*facts).collect()
    floor: dict[int, dict[str, float]] = {_PREDICT: {}, _CALIBRATE: {}}
    for r in rows:
        if r["order"] == 1:
            floor[r["set"]][r["lang"]] = _discount(r["ones"], r["twos"]) * r["kinds"] / r["total"] / (r["kinds"] + 1)
    out, lower = None, None
    for order in range(1, ORDER + 1):
        known = [(r["set"], r["lang"], _discount(r["ones"], r["twos"]), floor[r["set"]][r["lang"]]) for r in rows if r["order"] == order]
        known = F.broadcast(counted.sparkSession.createDataFrame(known, "set int, lang string, d double, low double"))  # a row a language
        w = Window.partitionBy(*key, "context")
        g = levels[order].join(known, key).withColumn("context", F.expr(f"substring(gram, 1, {order - 1})"))
        g = g.withColumns({"total": F.sum("c").over(w), "kinds": F.count(F.lit(1)).over(w)}).withColumn("weight", F.col("d") * F.col("kinds") / F.col("total"))
        if order == 1:
            g = g.withColumn("below", F.col("low"))
        else:
            g = g.withColumn("end", F.expr("substring(gram, 2)")).join(lower, [*key, "end"]).withColumn("below", F.col("weight") * F.col("q"))
        p = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("below")
        g = checkpoint(g.select(*key, "gram", "context", "weight", p.alias("p")))
        lower = g.select(*key, F.col("gram").alias("end"), F.col("p").alias("q"))
        both = g.select(*key, F.lit("v").alias("kind"), "gram", "p")
        if order > 1:
            both = both.unionByName(g.groupBy(*key, F.lit("b").alias("kind"), F.col("context").alias("gram")).agg(F.first("weight").alias("p")))
        out = both if out is None else out.unionByName(both)
    return out, floor


def _hashed(table: DataFrame, languages: list[str], of: int) -> DataFrame:
    """(shard, kind, h, language, value) of table(lang, kind, gram, p)."""
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array([place[x] for x in batch.column(0).to_pylist()], np.int32)
            kind, gram, value = np.array(batch.column(1).to_pylist()), batch.column(2).to_pylist(), np.log(batch.column(3).to_numpy()).astype(np.float32)
            size = np.fromiter(map(len, gram), np.int64, len(gram))
            for k in ("v", "b"):
                for n in np.unique(size[kind == k]).tolist():
                    rows = np.flatnonzero((kind == k) & (size == n))
                    cp = np.frombuffer("".join([gram[i] for i in rows]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
                    pair = cp[:, -3:-1] if k == "v" else cp[:, -2:]
                    everywhere = of == 1 or pair.shape[1] < 2
                    shards = np.tile(np.arange(of), len(rows)) if everywhere else _shard_of(pair, of).astype(np.int64)
                    rows, h = (np.repeat(x, of) if everywhere else x for x in (rows, _gram_hash(cp)))
                    yield pa.record_batch([pa.array(shards, pa.int32()), pa.array([k] * len(rows), pa.string()), pa.array(h.view(np.int64)), pa.array(lang[rows]), pa.array(value[rows])], ["shard", "kind", "h", "language", "value"])

    return table.mapInArrow(run, "shard int, kind string, h long, language int, value float")


@dataclass
class Model:
    """Learned languages; of each its floor and, for rejection, middle and spread; the sharpness of scores; the table
    of hashes and its number of shards."""

    languages: list[str]
    floor: list[float]
    table: DataFrame | None
    shards: int
    limit: list[tuple[float, float]]
    sharpness: float = 1.0

    def shard(self, number: int) -> _Shard:
        if self.table is None:
            none = _Runs(np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
            return _Shard(none, none, np.zeros(0), 0, 1)
        runs = []
        for kind in ("v", "b"):
            rows = self.table.filter((F.col("shard") == number) & (F.col("kind") == kind)).select("h", "language", "value").toArrow()
            runs.append(_Runs.of(rows.column("h").to_numpy().view(np.uint64), rows.column("language").to_numpy().astype(np.uint16), rows.column("value").to_numpy()))
        return _Shard(*runs, np.array(self.floor), number, self.shards)


def _model(table: DataFrame, floor: dict[str, float], which: int, shard_entries: int) -> Model:
    languages = sorted(floor)
    if not languages:
        return Model([], [], None, 1, [])
    own = table.filter(F.col("set") == which).select("lang", "kind", "gram", "p")
    shards = -(-own.count() // shard_entries)
    hashed = checkpoint(_hashed(own, languages, shards))
    return Model(languages, [math.log(floor[x]) for x in languages], hashed, shards, [(math.inf, 0.0)] * len(languages))


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", shard_entries: int = SHARD) -> Model:
    """Learns from all rows with a non-null lang and text that are not held out; repeated rows count as often as they
    stand, a null id is no calibration row. A language is learned if its texts have a letter; one without documents on
    both sides of the calibration fold is never rejected. Without any row no language is learned."""
    counted = checkpoint(_count(docs, doc_id, lang, text))
    table, floor = kneser_ney(counted)
    model = _model(table, floor[_PREDICT], _PREDICT, shard_entries)
    trial = _model(table, floor[_CALIBRATE], _CALIBRATE, shard_entries)
    _calibrate(model, trial, docs, doc_id, text, lang)
    return model


def quantiles(rows: DataFrame, p: float) -> dict[int, float]:
    """The p-quantile of x by k of rows(k, x), exact, and between two places in proportion.

    No group is gathered or sorted: a pass counts the range that holds a place in BINS ranges and goes on with the one
    that has the place, until that place is at its end. The driver gets BINS rows a place and pass.
    """
    facts = [F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    whole = rows.groupBy("k").agg(*facts).collect()
    at = {r["k"]: (r["n"] - 1) * p for r in whole}
    ranges = {(r["k"], place): (place, r) for r in whole for place in {math.floor(at[r["k"]]), math.ceil(at[r["k"]])}}
    found: dict[tuple[int, int], float] = {}
    while ranges:
        left = []
        for key, (rest, r) in ranges.items():
            if rest == 0 or rest == r["n"] - 1 or r["lo"] == r["hi"]:
                found[key] = r["lo"] if rest == 0 else r["hi"]
            else:
                left.append((*key, rest, r["lo"], r["hi"]))
        if not left:
            break
        known = F.broadcast(rows.sparkSession.createDataFrame(left, "k int, place long, rest long, low double, high double"))  # two rows a language
        inside = rows.join(known, "k").filter(F.col("x").between(F.col("low"), F.col("high")))
        inside = inside.withColumn("bin", F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * BINS), F.lit(BINS - 1)))
        ranges = {}
        before: dict[tuple[int, int], int] = {}
        for r in sorted(inside.groupBy("k", "place", "rest", "bin").agg(*facts).collect(), key=lambda r: r["bin"]):
            key = r["k"], r["place"]
            rest = r["rest"] - before.get(key, 0)
            before[key] = before.get(key, 0) + r["n"]
            if 0 <= rest < r["n"]:
                ranges[key] = rest, r
    ends = {k: (found[k, math.floor(x)], found[k, math.ceil(x)], x - math.floor(x)) for k, x in at.items()}
    return {k: lo + (hi - lo) * part for k, (lo, hi, part) in ends.items()}


def _calibrate(model: Model, trial: Model, docs: DataFrame, doc_id: str, text: str, lang: str) -> None:
    """Sets limits and sharpness by the trial model's cross-entropies of all documents of the fold, which it did not
    count. The driver gets counts and sums by language; of a document no more than its sums is written."""
    if not trial.languages:
        return
    held = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (_fold(F.col(doc_id)) == CALIBRATION_FOLD))
    held = held.select((F.array_position(F.array(*[F.lit(x) for x in trial.languages]), F.col(lang).cast("string")) - 1).cast("int").alias("k"), F.col(text).alias("t"))
    scored = _sums(held.filter("k >= 0"), trial, "t").filter("_lm_n > 0")
    scored = checkpoint(scored.select("k", F.sqrt(F.col("_lm_n").cast("double")).alias("root"), F.transform("_lm_sums", lambda x: x / F.col("_lm_n")).alias("entropy")))
    own = scored.select("k", "root", F.expr("entropy[k]").alias("x"))
    middle = quantiles(own, 0.5)
    if not middle:
        return
    middles = F.array(*[F.lit(middle.get(k, 0.0)) for k in range(len(trial.languages))])
    spread = quantiles(own.select("k", ((F.col("x") - F.get(middles, F.col("k"))) * F.col("root")).alias("x")), CALIBRATION)
    for k, x in middle.items():
        model.limit[model.languages.index(trial.languages[k])] = x, spread[k]
    # The flattest scores whose log loss is the least, within a thousandth.
    grid = 2.0 ** np.linspace(-3, 6, 37)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(grid)), 0
        for batch in batches:
            mine, root = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            entropy = np.asarray(batch.column(2).flatten()).reshape(len(mine), -1)
            ahead = (entropy - entropy[np.arange(len(mine)), mine][:, None]) * root[:, None]
            total += [float(np.sum(np.logaddexp.reduce(-b * ahead, axis=1))) for b in grid]
            n += len(mine)
        yield pa.record_batch([pa.array(np.arange(len(grid))), pa.array(total), pa.array(np.full(len(grid), n))], ["b", "total", "n"])

    mean = scored.mapInArrow(losses, "b long, total double, n long").groupBy("b").agg((F.sum("total") / F.sum("n")).alias("loss"))
    loss = np.array([r["loss"] for r in sorted(mean.collect(), key=lambda r: r["b"])])
    model.sharpness = float(grid[int(np.flatnonzero(loss <= loss.min() + 1e-3)[0])])


def _sums(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """Adds _lm_sums (nats by language) and _lm_n (characters); every shard of the model adds its part in one pass."""
    names, fields = docs.columns, docs.schema.fields
    column, languages = names.index(text), len(model.languages)
    out = T.StructType([*fields, T.StructField("_lm_sums", T.ArrayType(T.DoubleType())), T.StructField("_lm_n", T.LongType())])
    for number in range(model.shards):
        shared = docs.sparkSession.sparkContext.broadcast(model.shard(number))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number: int = number) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for batch in batches:
                parts = [m.sums(group) for group in _groups(t.as_py() for t in batch.column(column))]
                total, size = np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])
                if number:
                    total += np.array(batch.column(len(names)).flatten()).reshape(len(size), languages)
                offsets = pa.array(np.arange(len(size) + 1) * languages, pa.int32())
                yield pa.record_batch([*batch.columns[: len(names)], pa.ListArray.from_arrays(offsets, pa.array(total.ravel(), pa.float64())), pa.array(size)], [*names, "_lm_sums", "_lm_n"])

        docs = docs.mapInArrow(run, out)
        if number < model.shards - 1:
            docs = checkpoint(docs)
            shared.unpersist()
    return docs


_ADDED = ("lang_pred", "score", "cross_entropy", "rejected")


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (the share of the chosen language among the learned ones, by the calibrated sharpness),
    cross_entropy (nats a character; null where undetermined) and rejected (beyond the calibrated limit, or
    undetermined) to every row.

    A text that is null, empty or without a letter is `und` with score 0; so is every text if no language was learned.
    Equal cross-entropies go to the language that sorts first. Repeated rows get equal results; columns named like one
    that is added are replaced (names that start with _lm_ are reserved).
    """
    names = [c for c in docs.columns if c not in _ADDED]
    rows = _sums(docs.select(*[F.col(f"`{c}`") for c in names]), model, text)
    known = (F.col("_lm_n") > 0) & F.lit(bool(model.languages))
    n = F.col("_lm_n").cast("double")
    languages = F.array(*[F.lit(x) for x in model.languages]) if model.languages else F.array(F.lit(UNDETERMINED))
    limits = [F.array(*[F.lit(float(x[i])) for x in model.limit]) if model.limit else F.array(F.lit(0.0)) for i in (0, 1)]
    rows = rows.withColumn("_lm_least", F.array_min("_lm_sums"))
    rows = rows.withColumn("_lm_best", F.when(known, F.array_position("_lm_sums", F.col("_lm_least")).cast("int")).otherwise(F.lit(1)))
    entropy = F.col("_lm_least") / n
    # Characters depend on each other: a text tells about as much as the root of its length would.
    share = F.aggregate("_lm_sums", F.lit(0.0), lambda acc, x: acc + F.exp((F.col("_lm_least") - x) / F.sqrt(n) * model.sharpness))
    middle, spread = (F.element_at(x, F.col("_lm_best")) for x in limits)
    return rows.select(
        *[F.col(f"`{c}`") for c in names], F.when(known, F.element_at(languages, F.col("_lm_best"))).otherwise(F.lit(UNDETERMINED)).alias("lang_pred"),
        F.when(known, 1 / share).otherwise(F.lit(0.0)).alias("score"), F.when(known, entropy).alias("cross_entropy"),
        F.when(known, entropy > middle + spread / F.sqrt(n)).otherwise(F.lit(True)).alias("rejected"))

"""Personal data: fixed patterns, widened by bootstrapped contextual extraction. DataFrame functions only.

Base matches (e-mail and IP addresses, card and phone numbers) are the seeds. The last one to PHRASE words before them
and the first ones behind them induce lexical patterns. Identifier-like strings that no base pattern takes are
candidates; candidates and seeds form a graph with the patterns around them. In each round a pattern's confidence in a
kind is the score of its instances over all places where its phrase stands in the corpus (so a frequent word proves
nothing, while a phrase that ends in one may), and a candidate's score is the noisy-or of the best pattern before and
the best one behind it (shorter and longer phrases of a side say the same, so they don't add up). Candidates that end at
MIN_SCORE or more become spans of that kind.

Positions come from splitting a text at the matches of a pattern: lengths of pieces and matches add up to offsets in
code points. Phrases are lower-cased whole words, of any length, and go by their hashes. Mentions are counted by
(pattern, instance) before they are shuffled, so that a string in a third of all documents is one row for each task.
Phrases of the corpus are counted only where a filter of SLOTS places, whatever the number of patterns, lets them pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolode.llm._session import checkpoint, hot_join

# The base patterns, as they are matched leftmost and without overlap. The lookbehinds and possessive
# quantifiers leave the matches as they are and keep long runs from being scanned again from each of their characters.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
# Candidates: runs of 7 or more digits with light punctuation, and addresses that are incomplete or spelt out.
NUMBER = r"(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,}+(?![A-Za-z0-9])"
MAILISH = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[({]at[\])}]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[({]dot[\])}]\x20?)[A-Za-z0-9-]++)*+"
MIN_SUPPORT = 5
MIN_CONFIDENCE = 0.6
MIN_SCORE = 0.8
ROUNDS = 3
PHRASE = 3
SLOTS = 1 << 18
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string,item:string,l:string,r:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    n = F.length(_digits(s))
    return {
        "email": F.lit(True), "mailish": F.lit(True),
        "ip": s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"),
        "card": F.when(n.between(14, 19), _luhn(_digits(s))).otherwise(False),
        "phone": n.between(10, 15),
        "number": n.between(7, 19),
    }[kind]


#: The first words of a text, by possessive steps, so that nothing is read twice.
_AHEAD = rf"^\s*+(\S++(?:\s++\S++){{0,{PHRASE - 1}}}+)"


def _phrases(words: Column, before: bool) -> Column:
    """Hashes of the last (before) or first one to PHRASE of the given words."""
    w = F.filter(F.split(F.lower(words), r"\s+"), lambda x: x != "")
    each = [F.when(F.size(w) >= k, F.xxhash64(F.concat_ws(" ", F.slice(w, -k if before else 1, k)))) for k in range(1, PHRASE + 1)]
    return F.array_compact(F.array(*each))


def _spans(pieces: Column, matches: Column, kind: str, rank: int) -> Column:
    """Valid matches with their offsets and the words around them."""
    each = F.transform(F.when(F.size(matches) > 0, F.sequence(F.lit(0), F.size(matches) - 1)).otherwise(F.array().cast("array<int>")),
                       lambda i: F.struct(F.get(pieces, i).alias("p"), F.get(matches, i).alias("m"), F.get(pieces, i + 1).alias("q")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["p"])
        end = start + F.length(x["m"])
        left, right = F.reverse(F.regexp_extract(F.reverse(x["p"]), _AHEAD, 1)), F.regexp_extract(x["q"], _AHEAD, 1)
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("item"), left.alias("l"), right.alias("r")))
        return F.struct(end.alias("pos"), F.when(_valid(kind, x["m"]), F.concat(acc["spans"], one.cast(_SPAN))).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast(_SPAN).alias("spans"))
    return F.aggregate(each, start, add, lambda acc: acc["spans"])


def annotate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, cand): spans of the base patterns by start and kind, and candidates apart from them;
    l and r of a span hash the phrases before and behind it."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), t.alias("t"))
    rows = rows.withColumn("d", F.col("t").rlike("[0-9]"))
    at, digit, plus = F.contains("t", F.lit("@")), F.col("d"), F.col("d") & F.contains("t", F.lit("+"))
    spelt = at | F.col("t").rlike(r"[\[({]at[\])}]")
    kinds = (("email", EMAIL, at), ("ip", IP, digit), ("card", CARD, digit), ("phone", PHONE, plus), ("number", NUMBER, digit), ("mailish", MAILISH, spelt))
    none = F.array().cast("array<string>")
    for kind, rx, maybe in kinds:
        rows = rows.withColumn(f"m_{kind}", F.when(maybe, F.regexp_extract_all("t", F.lit(rx), F.lit(0))).otherwise(none))
    for kind, rx, _ in kinds:
        rows = rows.withColumn(f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("t", rx, -1)).otherwise(none))
    found = {kind: _spans(F.col(f"p_{kind}"), F.col(f"m_{kind}"), kind, rank) for rank, (kind, _, _) in enumerate(kinds)}
    rows = rows.select("doc_id", "text_hash", F.array_sort(F.concat(*[found[k] for k in KINDS])).alias("base"), F.concat(found["number"], found["mailish"]).alias("cand"))
    apart = F.filter("cand", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = rows.withColumn("cand", apart)

    def hashed(x: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("start", "rank", "end", "kind", "item")], _phrases(x["l"], True).alias("l"), _phrases(x["r"], False).alias("r"))

    return rows.select("doc_id", "text_hash", *[F.transform(c, hashed).alias(c) for c in ("base", "cand")])


def _totals(docs: DataFrame, text: str, slots: DataFrame) -> DataFrame:
    """(phrase, total): how often the phrases of slots, and some others, stand in the texts."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda x: x != "")
    # The condition, always true, keeps the optimizer from putting the split in place of each use of the column.
    rows = docs.select(F.when(F.rand() >= 0, words).otherwise(F.array().cast("array<string>")).alias("w"))
    following = F.arrays_zip(*[F.slice("w", k, F.greatest(F.size("w"), F.lit(1))).alias(f"w{k}") for k in range(1, PHRASE + 1)])

    def hashes(x: Column) -> Column:
        return F.array(*[F.when(x[f"w{k}"].isNotNull(), F.xxhash64(F.concat_ws(" ", *[x[f"w{i}"] for i in range(1, k + 1)]))) for k in range(1, PHRASE + 1)])

    each = F.array_compact(F.flatten(F.transform(following, hashes)))
    place = F.col("phrase").bitwiseAND(SLOTS - 1).alias("place")
    places = F.broadcast(slots.select(place).distinct())  # at most SLOTS rows
    phrases = rows.select(F.explode(each).alias("phrase")).select("phrase", place)
    return phrases.join(places, "place", "left_semi").groupBy("phrase").agg(F.count(F.lit(1)).alias("total"))


def discover(found: DataFrame, docs: DataFrame, *, text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(item, class, kind): candidate strings of found (see annotate) that the patterns around them mark, each with
    its likeliest kind; of equal scores the last kind by name."""
    def mentions(column: str) -> DataFrame:
        return found.select(F.explode(column).alias("x")).select(F.col("x.item").alias("item"), F.col("x.kind").alias("class"), "x.l", "x.r")

    raw = mentions("base").unionByName(mentions("cand"))
    sides = F.explode(F.concat(*[F.transform(side, lambda h, side=side: F.struct(F.lit(side).alias("side"), h.alias("phrase"))) for side in ("l", "r")]))
    edges = raw.select("item", "class", sides.alias("s")).groupBy("s.side", "s.phrase", "item", "class").agg(F.count(F.lit(1)).alias("n"))
    edges = checkpoint(edges)
    # Fewer instances than a pattern needs can't become one.
    slots = checkpoint(edges.groupBy("side", "phrase").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("seen")).filter(F.col("rows") >= MIN_SUPPORT))
    totals = _totals(docs, text, slots)
    slots = slots.join(totals, "phrase", "left").select("side", "phrase", "rows", F.greatest(F.coalesce("total", F.lit(0)), "seen").alias("total"))
    slots = checkpoint(slots)
    edges = checkpoint(hot_join(edges, slots, ["side", "phrase"], "rows"))
    seed = edges.filter(F.col("class").isin(*KINDS))
    rest = edges.filter(F.col("class").isin("number", "mailish")).drop("rows", "total")
    seeds = seed.select("item", "class", F.col("class").alias("kind"), F.lit(1.0).alias("score")).distinct()
    scores = seeds
    for _ in range(rounds):
        hits = edges.join(scores, ["item", "class"])
        patterns = hits.groupBy("side", "phrase", "kind").agg(
            F.sum(F.col("score") * F.col("n")).alias("mass"), F.max("total").alias("total"), F.max("rows").alias("rows"), F.sum(F.when(F.col("score") >= 0.5, 1).otherwise(0)).alias("support"))
        patterns = patterns.withColumn("confidence", F.col("mass") / F.col("total")).filter((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE))
        patterns = checkpoint(patterns.groupBy("side", "phrase").agg(F.max("rows").alias("rows"), F.collect_list(F.struct("kind", "confidence")).alias("marks")))  # at most a row a kind
        marked = hot_join(rest, patterns, ["side", "phrase"], "rows").select("item", "class", "side", F.explode("marks").alias("m")).select("item", "class", "side", "m.kind", "m.confidence")
        fits = (F.col("kind") == "email") == (F.col("class") == "mailish")
        best = marked.filter(fits).groupBy("item", "class", "kind", "side").agg(F.max("confidence").alias("confidence"))
        found_ = best.groupBy("item", "class", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("score"))
        scores = checkpoint(seeds.unionByName(found_))
    best = scores.filter(F.col("class").isin("number", "mailish") & (F.col("score") >= MIN_SCORE))
    return best.groupBy("item", "class").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, spans): one row for each row of docs; spans hold base and what the method adds.

    A null text counts as empty; empty texts have no spans; rows that repeat get the same spans; a null id passes
    through; spans of different kinds may overlap. Columns that are not named play no part.
    """
    found = checkpoint(annotate(docs, doc_id=doc_id, text=text))
    new = discover(found, docs, text=text)
    cand = found.filter(F.size("cand") > 0).select("doc_id", "text_hash", F.explode("cand").alias("x")).distinct()
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    extra = (cand.join(new, (F.col("x.item") == F.col("item")) & (F.col("x.kind") == F.col("class")))
             .groupBy(F.col("doc_id").alias("e_id"), F.col("text_hash").alias("e_hash"))
             .agg(F.collect_list(F.struct(F.col("x.start").alias("start"), rank.alias("rank"), F.col("x.end").alias("end"), "kind", "item", F.col("x.l").alias("l"), F.col("x.r").alias("r"))).alias("extra")))
    out = found.join(extra, F.col("doc_id").eqNullSafe(F.col("e_id")) & (F.col("text_hash") == F.col("e_hash")), "left")
    spans = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(found.schema["base"].dataType))))
    return out.select("doc_id", "text_hash", "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets, the first kind where spans overlap.

    n_chars, where docs have it, follows the text of changed rows. Every other column, and rows without spans, stay.
    """
    found = find(docs, doc_id=doc_id, text=text).filter(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("_pii_id"), F.col("text_hash").alias("_pii_hash"), F.col("spans").alias("_pii_spans")).dropDuplicates(["_pii_id", "_pii_hash"])
    rows = docs.withColumn("_pii_own", F.xxhash64(text))
    rows = rows.join(found, (F.col("_pii_own") == F.col("_pii_hash")) & rows[doc_id].eqNullSafe(F.col("_pii_id")), "left")

    def cut(acc: Column, x: Column) -> Column:
        gap = F.substring(F.col(text), (acc["pos"] + 1).cast("int"), (x["start"] - acc["pos"]).cast("int"))
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"), F.when(x["start"] >= acc["pos"], F.concat(acc["out"], gap, F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("_pii_spans", F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out")), cut,
                       lambda acc: F.concat(acc["out"], F.substring(F.col(text), (acc["pos"] + 1).cast("int"), F.length(F.col(text)))))
    changed = F.col("_pii_spans").isNotNull()
    # Apart, as a lambda would take a new column `text` beside it for the old one.
    rows = rows.withColumn("_pii_new", F.when(changed, done).otherwise(F.col(text)))
    columns = []
    for c in docs.columns:
        own = F.col(f"`{c}`")
        if c == text:
            own = F.col("_pii_new").alias(c)
        elif c == n_chars:
            own = F.when(changed, F.length("_pii_new").cast(docs.schema[c].dataType)).otherwise(own).alias(c)
        columns.append(own)
    return rows.select(*columns)

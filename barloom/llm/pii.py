"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are what fixed forms find: e-mail and IP addresses, card and phone numbers. The words before and after a seed are
lexical patterns of its kind. Patterns and instances (values) form a bipartite graph over all documents; a pattern's score
is the share of trusted instances among everything that stands at it, an instance's is the chance that one of its patterns
is right. Instances of the right shape with a high score become seeds themselves: the words around them are patterns in
the next round, which find further instances that no first seed's words lead to. Rounds go on until none is added.

Positions come from splitting a text at the matches: the lengths of pieces and matches up to a match, summed over the
document's matches, are its place in code points. Every form begins only where a run begins or the last match ended and
takes its runs possessively, so that long runs cost linear time.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._tables import drop, free_names, saved

KINDS = ("email", "ip", "card", "phone")
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:at|\(at\)|\[at\])", r"(?:\.|dot|\(dot\)|\[dot\])"
_SPELT = rf"[A-Za-z0-9._%+-]++\x20{_AT}\x20[A-Za-z0-9-]++(?:\x20?{_DOT}\x20?[A-Za-z0-9-]++)++"
_ENDS = r"(?=[.,;]?(?:[\x20\x09-\x0D]|$))"
#: What the contextual step looks at: a spelt-out address, a dashed number, digit groups between blanks, or any word with
#: a digit or a spelt-out at sign.
CANDIDATE = rf"(?<![^\x20\x09-\x0D])(?:{_SPELT}|[0-9]{{2,4}}[-.][0-9]{{3,4}}[-.][0-9]{{3,5}}{_ENDS}|\(?[0-9]{{2,5}}\)?(?:[\x20.-][0-9]{{2,5}}){{1,4}}{_ENDS}|(?=[^\x20\x09-\x0D0-9(\[]*+(?:[0-9]|\(at\)|\[at\]))[^\x20\x09-\x0D]++)"
#: Shapes in which an unseen identifier of each kind may come.
SHAPES = {
    "email": rf"^[A-Za-z0-9._%+-]+(?:\(at\)|\[at\])[A-Za-z0-9-]+(?:(?:\.|\(dot\)|\[dot\])[A-Za-z0-9-]+)+|^{_SPELT}$",
    "ip": r"^\[?(?:[0-9]{1,3}\.){3}[0-9xX*]{1,3}(?::[0-9]{1,5})?\]?$|^(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F:]*$",
    "card": r"^[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{1,7}[.,;]?$",
    "phone": r"^\(?[0-9]{2,4}\)?[-.][0-9]{3,4}[-.][0-9]{3,5}[.,;]?$|^(?=(?:[^0-9]*[0-9]){7,15}[^0-9]*$)\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,5}){1,4}$",
}
#: Score from which an instance is believed.
TRUST = 0.6
#: Distinct trusted instances that a pattern needs, and the score below which it says nothing.
LEAST_SEEDS = 2
LEAST_PATTERN = 0.2


def _last_word(text: Column) -> Column:
    """The last word of a text, in lower case; empty where it has none."""
    return F.lower(F.substring_index(F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " ", -1))


def _first_word(text: Column) -> Column:
    """The first word of a text, in lower case; empty where it has none."""
    return F.lower(F.substring_index(F.ltrim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), " ", 1))


def _pieces(text: Column, form: str, kind: str, may: Column) -> Column:
    """Array of (kind, i, gap, value, tail, head): each match, the length of the piece before it, that piece's last word and the next piece's first."""
    found = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    pieces = F.split(text, form, -1)
    around = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), F.slice(pieces, F.lit(2), F.size(found)), lambda a, b: F.struct(F.length(a).alias("gap"), _last_word(a).alias("tail"), _first_word(b).alias("head")))
    rows = F.zip_with(found, around, lambda m, p: F.struct(m.alias("value"), p.gap.alias("gap"), p.tail.alias("tail"), p.head.alias("head")))
    rows = F.transform(rows, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x.gap.alias("gap"), x.value.alias("value"), x.tail.alias("tail"), x.head.alias("head")))
    return F.when(may, rows).otherwise(F.array().cast("array<struct<kind:string,i:int,gap:int,value:string,tail:string,head:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check sum of a string of digits is right."""
    doubled = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    part = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    ip = F.forall(part, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    card = F.when((n >= 16) & (n <= 19), luhn(F.substring(digits, 1, 19))).otherwise(False)
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", (n >= 8) & (n <= 15)).otherwise(False)


def matches(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): one narrow row per document with ``row`` and digest; every match of a form or candidate with its place."""
    t = F.coalesce(F.col(text), F.lit(""))
    digit = t.rlike("[0-9]")
    may = {"email": F.contains(t, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(t, F.lit("+")) & digit}
    found = F.concat(*[_pieces(t, FORMS[k], k, may[k]) for k in KINDS], _pieces(t, CANDIDATE, "candidate", digit | F.contains(t, F.lit("at)")) | F.contains(t, F.lit("at]")) | F.contains(t, F.lit("dot ")) | t.rlike(r"\x20at\x20[A-Za-z0-9-]+\x20?\.")))
    table = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.md5(t.cast("binary")).alias("digest"), found.alias("found"))
    # row numbers are written with the rows, so that they don't depend on how files are split later
    table = saved(table.withColumn("row", F.monotonically_increasing_id()), "pii-matches")
    flat = table.where(F.size("found") > 0).select("row", F.inline("found"))
    size = F.length("value")
    order = Window.partitionBy("row", "kind").orderBy("i")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + size).over(upto)
    word = F.when(F.col("tail") != "", F.col("tail"))
    # the word right before, which may end another match, and the nearest one that stands between matches
    near = F.coalesce(word, _last_word(F.lag("value").over(order)), F.lit(""))
    far = F.coalesce(F.last(word, ignorenulls=True).over(upto), F.lit(""))
    spans = flat.withColumns({"end": end, "near": near, "far": far}).withColumn("start", F.col("end") - size)
    side = lambda mark, c: F.when(F.col(c) != "", F.concat(F.lit(mark), F.col(c)))
    patterns = F.array_distinct(F.array_compact(F.array(side("<", "near"), side("<", "far"), side(">", "head"))))
    return table.drop("found"), spans.select("row", "kind", "start", "end", "value", patterns.alias("patterns"))


def discover(spans: DataFrame, rounds: int | None = None, trust: float = TRUST, least_seeds: int = LEAST_SEEDS, least_pattern: float = LEAST_PATTERN) -> DataFrame:
    """Spans (row, kind, start, end) of unseen identifiers; ``spans`` has base matches and candidates with ``ok``.

    The graph has one edge per kind, pattern and value, so repeated sentences count once. Seeds keep a score of 1. Scores
    never fall from round to round, so instances are only added; the rounds end where one adds none, or after ``rounds``.
    """
    base = spans.where("ok")
    boxes = base.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("boxes"))  # one document's own matches
    loose = spans.where("kind = 'candidate'").join(boxes, "row", "left")
    loose = loose.where(~F.exists(F.coalesce("boxes", F.array().cast("array<struct<start:long,end:long>>")), lambda b: (b.start < F.col("end")) & (F.col("start") < b.end))).drop("boxes")
    loose = saved(loose.withColumn("pattern", F.explode("patterns")).drop("patterns"), "pii-loose")
    shaped = F.array_compact(F.array(*[F.when(F.col("value").rlike(SHAPES[k]), F.lit(k)) for k in KINDS]))
    seeds = base.select("kind", F.explode("patterns").alias("pattern"), "value").distinct()
    found = loose.select("pattern", "value", F.explode(shaped).alias("kind")).distinct()
    edges = saved(seeds.withColumn("seed", F.lit(True)).unionByName(found.withColumn("seed", F.lit(False))), "pii-edges")
    everything = seeds.select("pattern", "value").unionByName(loose.select("pattern", "value"))
    behind = saved(everything.groupBy("pattern").agg(F.countDistinct("value").alias("behind")), "pii-behind")
    known = edges.where("seed").select("kind", "value", F.lit(1.0).alias("score")).distinct()
    trusted, before, kept = known, 0, []
    for _ in itertools.count() if rounds is None else range(max(rounds, 1)):
        support = edges.join(trusted, ["kind", "value"]).groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s")).where(F.col("n") >= least_seeds)
        pattern = support.join(behind, "pattern").select("kind", "pattern", (F.col("s") / (F.col("behind") + 1)).alias("p")).where(F.col("p") >= least_pattern)
        pattern = saved(pattern, "pii-patterns")
        chance = 1 - F.exp(F.sum(F.log(1 - F.least(F.col("p"), F.lit(0.999)))))
        instance = edges.where("not seed").join(pattern, ["kind", "pattern"]).groupBy("kind", "value").agg(chance.alias("score")).where(F.col("score") >= trust)
        instance = saved(instance, "pii-instances")
        for t in kept:
            drop(t)
        kept = [pattern, instance]
        now = instance.count()
        trusted = known.unionByName(instance.join(known, ["kind", "value"], "left_anti"))
        if now == before:
            break
        before = now
    trim = F.length("value") - F.length(F.regexp_replace("value", "[.,;]+$", ""))
    spots = loose.drop("kind").join(instance.select("kind", "value"), "value").join(pattern.select("kind", "pattern"), ["kind", "pattern"], "left_semi")
    out = saved(spots.select("row", "kind", "start", (F.col("end") - trim).alias("end")).distinct(), "pii-found")
    for t in (loose, edges, behind, *kept):
        drop(t)
    return out


def find_personal_data(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Spans of personal data in every whole text.

    Returns the ``keep`` columns, digest (MD5 of the text) and base and spans: arrays of (kind number, kind, start,
    end) in the order of KINDS and places, in code points, end exclusive. Null and empty texts have none; repeated rows
    get a row each; an empty table gives no rows.
    """
    rows, spans = matches(docs, text, keep)
    spans = saved(spans.withColumn("ok", valid(F.col("kind"), F.col("value"))), "pii-spans")
    extra = discover(spans)
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    every = spans.where("ok").select("row", "kind", "start", "end", F.lit(True).alias("base")).unionByName(extra.withColumn("base", F.lit(False)))
    span = F.struct(number.alias("no"), F.col("kind"), F.col("start"), F.col("end"))
    per = every.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"), F.array_sort(F.collect_set(span)).alias("spans"))
    none = F.array().cast("array<struct<no:int,kind:string,start:bigint,end:bigint>>")
    out = rows.join(per, "row", "left")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "digest", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", most_broadcast: int = 100_000) -> DataFrame:
    """All columns of ``docs``, each span of personal data in ``text`` replaced by its kind in brackets; no row is dropped.

    Spans depend on the text alone, so they are joined by the text's digest. Overlapping spans become one, named after
    the first of them.
    """
    digest, spans = free_names(docs, "digest", "spans")
    found = find_personal_data(docs, text, ())
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.no.alias("no"), s.end.alias("end"), s.kind.alias("kind"))))
    one = F.aggregate(ordered, F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"), lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1).end > s.start), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, -1).start.alias("start"), F.greatest(F.element_at(a, -1).end, s.end).alias("end"), F.element_at(a, -1).kind.alias("kind"))))).otherwise(F.concat(a, F.array(F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))))
    found = saved(found.where(F.size("spans") > 0).groupBy("digest").agg(F.first("spans").alias("spans")).select(F.col("digest").alias(digest), one.alias(spans)), "pii-redactions")
    if found.limit(most_broadcast + 1).count() <= most_broadcast:
        found = F.broadcast(found)
    joined = docs.join(found, F.md5(F.coalesce(docs[text], F.lit("")).cast("binary")) == F.col(digest), "left")
    t = docs[text]
    upto = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.element_at(spans, i).end)
    parts = F.transform(spans, lambda s, i: F.concat(F.substring(t, (upto(i) + 1).cast("int"), (s.start - upto(i)).cast("int")), F.lit("["), F.upper(s.kind), F.lit("]")))
    last = F.element_at(spans, -1).end
    clean = F.concat(F.array_join(parts, ""), F.substring(t, (last + 1).cast("int"), F.length(t)))
    return joined.select(*[F.when(F.col(spans).isNull(), t).otherwise(clean).alias(c) if c == text else docs[c] for c in docs.columns])


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))

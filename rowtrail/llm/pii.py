"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base rules find emails, IP addresses, cards and phone numbers; their matches are
kept as they are. Three generators of high recall propose further spans, which may
overlap: addresses, also with the signs spelt out ("at", "dot"), runs of digits with
any separators, and values that may be secrets. Boosted trees score them by format
and context, a threshold calibrated for each kind selects them, and of overlapping
ones the best score wins.

Positive examples are the candidates that base rules confirm, values that a word
such as "token" announces, and seeded variants of both: spelt-out signs, other
separators, a missing plus, another announcing word. Negative examples are those
whose format rules out every kind: numbers of a wrong length or check sum, dates,
addresses without a plausible top-level domain, values without letters or digits or
made of words.
All other candidates are unlabelled: they are scored, but teach nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

#: The kinds in their order, and their rules. Possessive loops and the
#: look-behinds change no match; they keep long texts from taking quadratic time or deep recursion.
KINDS = ("email", "ip", "card", "phone", "secret")  # no base rule finds a secret
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "address": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?[\[(](?i:at)[\])]\x20?|\x20(?i:at)\x20|\x20?@\x20?)[A-Za-z0-9-]++(?:(?:\x20?[\[(](?i:dot)[\])]\x20?|\x20(?i:dot)\x20|\.)[A-Za-z0-9-]++)++",
    "number": r"(?:\G|(?<![0-9]))\+?\(?[0-9](?:[\x20().\x2D/]{0,2}[0-9])++",
    "value": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,40}[0-9])[A-Za-z0-9+/_-]{16,}+|(?<=[=:][\"'\x20]{0,2})[A-Za-z0-9+/_-]{8,}+",
}
#: Words that announce a secret, and beginnings of well-known keys.
SECRET_WORDS = r"(?i)(?:token|secret|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|credential|bearer)[\"'\x20]{0,2}[=:]?[\"'\x20]{0,2}$"
SECRET_HEADS = r"^(?:AKIA|ASIA|gh[opsu]_|sk-|xox[abp]-|eyJ)"
#: Top-level domains besides those of two letters, and the shape of dates.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|name|app|dev|cloud|online|site|shop|blog|example|test|invalid|localhost"
DATE = r"^(?:(?:19|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]|[0-3]?[0-9][./-][0-3]?[0-9][./-](?:19|20)[0-9]{2})(?:[\x20][0-9]{1,2})?$"
#: Every address has one of these; texts without them are spared the generator.
AT_SIGN = r"@|[\[(](?i:at)[\])]|\x20(?i:at)\x20"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})){3}$"
#: The trees are fitted on half of at most so many examples, the least by a hash over all of them; thresholds are set on all.
TRAIN_ROWS = 20_000
PRECISION = 0.98
FEATURES = ["n_digits", "size", "dots", "dashes", "spaces", "parens", "at_sign", "groups", "longest_group", "luhn", "octets", "date", "domain", "spelt", "n_letters", "signs", "mixes", "hex", "letter_before", "letter_after", "quote_before", "contact_word", "payment_word", "secret_word", "secret_head"]


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn_ok(number: Column) -> Column:
    """The check sum of a text of at most 19 digits."""
    places = F.sequence(F.lit(1), F.length(number))
    doubled = F.transform(places, lambda i: (lambda d, even: F.when(even & (d > 4), d * 2 - 9).when(even, d * 2).otherwise(d))(F.substring(F.reverse(number), i, F.lit(1)).cast("int"), i % 2 == 0))
    return F.coalesce(F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0, F.lit(False))


def card_ok(found: Column) -> Column:
    n = F.length(digits(found))
    return F.when((n >= 12) & (n <= 19), luhn_ok(digits(found))).otherwise(False)


def valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(OCTETS)
    if kind == "card":
        return card_ok(found)
    if kind == "phone":
        return F.length(digits(found)).between(9, 15)
    return F.lit(True)


def matches(text: Column, name: str, pattern: str, hint: Column) -> Column:
    """All matches with the length of the gap before each and the text around it.

    Splitting by the pattern gives the gaps between the matches, so positions need
    no scan of their own.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    both = F.struct(found.alias("m"), gaps.alias("g"))
    made = F.transform(F.array(both), lambda b: F.transform(b["m"], lambda m, i: F.struct(
        F.lit(name).alias("source"), i.alias("no"), F.char_length(F.get(b["g"], i)).alias("gap"), m.alias("found"),
        F.right(F.get(b["g"], i), F.lit(24)).alias("before"), F.left(F.get(b["g"], i + 1), F.lit(1)).alias("after"),
    )))
    return F.when(hint, F.get(made, F.lit(0)))


def proposals(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``spans``: each base match and candidate as source, no, gap, found, before, after."""
    digit, at = F.col(text_col).rlike("[0-9]"), F.instr(text_col, "@") > 0
    hints = {"email": at, "ip": digit, "card": digit, "phone": F.instr(text_col, "+") > 0, "address": F.col(text_col).rlike(AT_SIGN), "number": digit, "value": digit | F.col(text_col).rlike("[=:]")}
    none = F.array().cast("array<struct<source:string,no:int,gap:int,found:string,before:string,after:string>>")
    found = [F.coalesce(matches(F.col(text_col), name, pattern, hints[name]), none) for name, pattern in (BASE | WIDE).items()]
    return docs.withColumn("spans", F.concat(*found))


def positioned(rows: DataFrame) -> DataFrame:
    """One row for each span: row, print, source, start, end, found, before, after."""
    flat = rows.select("row", "print", F.explode("spans").alias("s")).select("row", "print", "s.*")
    upto = Window.partitionBy("row", "source").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("found")
    end = F.sum(F.col("gap") + size).over(upto)
    return flat.withColumn("end", end).withColumn("start", F.col("end") - size).drop("gap", "no")


def overlapping(spans: DataFrame, fixed: Column) -> Column:
    """Whether a span shares a character with one for which ``fixed`` holds, within its row."""
    forth = Window.partitionBy("row").orderBy("start", F.desc(fixed), "end", "source").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc(fixed), F.desc("end"), "source").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(fixed, F.col("end"))).over(forth)
    ahead = F.min(F.when(fixed, F.col("start"))).over(back)
    return F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))


def variants(spans: DataFrame) -> DataFrame:
    """Seeded variants of confirmed spans: what the same data looks like in forms that the base rules miss."""
    pick, found, number = F.pmod(F.xxhash64("print", "start", "end", "source"), F.lit(3)), F.col("found"), digits(F.col("found"))
    address = F.when(pick == 0, F.replace(F.replace(found, F.lit("@"), F.lit(" at ")), F.lit("."), F.lit(" dot "))).when(pick == 1, F.replace(F.replace(found, F.lit("@"), F.lit(" (at) ")), F.lit("."), F.lit(" (dot) "))).otherwise(F.replace(found, F.lit("@"), F.lit(" [at] ")))
    plain = F.regexp_replace(found, r"^\+", "")
    phone = F.when(pick == 0, plain).when(pick == 1, F.regexp_replace(F.regexp_replace(plain, "[^0-9]+", "-"), "^-|-$", "")).otherwise(F.regexp_replace(F.regexp_replace(plain, "[^0-9]+", "."), r"^\.|\.$", ""))
    card = F.regexp_replace(number, "([0-9]{4})(?=[0-9])", F.when(pick == 0, F.lit("$1.")).when(pick == 1, F.lit("$1/")).otherwise(F.lit("$1  ")))
    announced = F.when(pick == 0, F.lit(" api_key: ")).when(pick == 1, F.lit(" password=")).otherwise(F.lit(' "secret": "'))
    changed = F.when(F.col("source") == "address", address).when(F.col("kind") == "phone", phone).when(F.col("kind") == "card", card).otherwise(found)
    moved = spans.where("known and kind <> 'ip'").withColumns({"found": changed, "before": F.when(F.col("source") == "value", announced).otherwise(F.col("before"))})
    return with_features(moved.select(*SPAN)).withColumn("known", F.lit(True)).where("kind is not null")


SPAN = ("row", "print", "source", "start", "end", "found", "before", "after", "in_base")


def with_features(spans: DataFrame) -> DataFrame:
    """Format and context features; ``like``, the kind that the span resembles most; ``kind``, the same where the format allows it; ``known``, whether it is confirmed."""
    plain = F.regexp_replace(F.regexp_replace("found", r"\x20?[\[(](?i:at)[\])]\x20?|\x20(?i:at)\x20|\x20?@\x20?", "@"), r"\x20?[\[(](?i:dot)[\])]\x20?|\x20(?i:dot)\x20", ".")
    plain = F.when(F.col("source") == "value", F.col("found")).otherwise(F.regexp_replace(plain, r"^\+", ""))
    count = lambda sign: F.length("plain") - F.length(F.replace("plain", F.lit(sign)))
    groups = F.split(F.regexp_replace("plain", r"[^0-9]+", " "), " ")
    before = F.lower("before")
    spans = spans.withColumn("plain", plain).withColumn("n_digits", F.length(digits(F.col("plain")))).withColumns({
        "size": F.length("plain"), "dots": count("."), "dashes": count("-"), "spaces": count(" "), "parens": count("("), "at_sign": count("@"),
        "groups": F.size(groups), "longest_group": F.array_max(F.transform(groups, F.length)),
        "luhn": card_ok(F.col("plain")).cast("int"), "octets": F.col("plain").rlike(OCTETS).cast("int"), "date": F.col("plain").rlike(DATE).cast("int"),
        "domain": F.col("plain").rlike(rf"@.*\.(?:[a-z]{{2}}|(?i:{DOMAINS}))$").cast("int"), "spelt": (F.length("plain") < F.length("found")).cast("int"),
        "n_letters": F.length(F.regexp_replace("plain", "[^A-Za-z]", "")), "signs": F.size(F.array_distinct(F.split("plain", ""))),
        "mixes": F.regexp_count("plain", F.lit("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]")), "hex": F.col("plain").rlike("^[0-9a-fA-F]+$").cast("int"),
        "letter_before": F.col("before").rlike(r"\p{L}$").cast("int"), "letter_after": F.col("after").rlike(r"^\p{L}").cast("int"),
        "quote_before": F.col("before").rlike("[\"'=]$").cast("int"),
        "contact_word": before.rlike("phone|tel|call|mail|fax|mobile|contact").cast("int"), "payment_word": before.rlike("card|visa|iban|account|pay").cast("int"),
        "secret_word": F.col("before").rlike(SECRET_WORDS).cast("int"), "secret_head": F.col("plain").rlike(SECRET_HEADS).cast("int"),
    })
    source, n = F.col("source"), F.col("n_digits")
    announced = (F.col("secret_word") == 1) | (F.col("secret_head") == 1)
    dotted = (F.col("groups") == 4) & (F.col("dots") == 3)
    like = F.when(source == "address", "email").when(source == "value", "secret").when(dotted & (n <= 12), "ip").when((n >= 12) & ((F.col("luhn") == 1) | (n > 15)), "card").otherwise("phone")
    allowed = (
        F.when(F.col("like") == "email", F.col("domain") == 1).when(F.col("like") == "ip", F.col("octets") == 1).when(F.col("like") == "card", F.col("luhn") == 1)
        .when(F.col("like") == "phone", n.between(9, 15) & (F.col("date") == 0) & ((F.col("groups") > 1) | F.col("found").startswith("+")))
        .otherwise((F.col("n_letters") > 0) & (n > 0) & (F.col("size") >= 8) & (F.col("signs") >= 6) & (announced | (F.col("mixes") >= 2)))
    )
    spans = spans.withColumn("like", like).withColumn("kind", F.when(allowed, F.col("like")))
    return spans.withColumn("known", F.when(source == "value", announced & ~F.col("in_base")).otherwise(F.col("in_base")) & F.col("kind").isNotNull())


def selected(candidates: DataFrame) -> DataFrame:
    """The candidates outside the base matches whose score reaches their kind's threshold: row, source, start, end, kind, score."""
    candidates = written(candidates, "pii-features")
    real = candidates.withColumn("real", F.lit(True))
    both = real.unionByName(variants(candidates).withColumn("real", F.lit(False)))
    order = F.xxhash64("print", "start", "end", "source", "real")
    label = F.when(F.col("known"), 1.0).when(F.col("kind").isNull() & ~F.col("in_base"), 0.0)
    both = written(both.select("row", "source", "start", "end", "like", "kind", "in_base", "real", label.alias("label"), order.alias("at"), *FEATURES), "pii-candidates")
    sample = both.where("label is not null").orderBy("at").limit(TRAIN_ROWS).withColumn("fits", F.pmod("at", F.lit(2)) == 0)
    sample = written(sample, "pii-sample").where("fits")
    classes = sample.agg(F.count(F.when(F.col("label") == 1, 1)).alias("yes"), F.count(F.when(F.col("label") == 0, 1)).alias("no")).first()
    none = both.where(F.lit(False)).select("row", "source", "start", "end", "kind", F.lit(0.0).alias("score"))
    if not classes.yes or not classes.no:
        return none
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = GBTClassifier(maxIter=10, maxDepth=3, seed=17).fit(assembler.transform(sample))
    scored = model.transform(assembler.transform(both)).select("row", "source", "start", "end", "like", "kind", "in_base", "real", "label", vector_to_array("probability")[1].alias("score"))
    scored = written(scored, "pii-scored")
    # over all examples of a kind: the lowest score from which upwards they are precise
    # enough, moved half-way to the best negative example below it
    rated = written(scored.where("label is not null").groupBy("like", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("yes")), "pii-scores")
    upto = Window.partitionBy("like").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    precise = rated.withColumn("right", F.sum("yes").over(upto) / F.sum("n").over(upto)).where((F.col("right") >= PRECISION) & (F.col("yes") > 0))
    least = precise.groupBy("like").agg(F.min("score").alias("least"))
    below = rated.where("n > yes").join(least, "like").where("score < least").groupBy("like").agg(F.max("score").alias("below"))
    rows = least.join(below, "like", "left").collect()  # one for each kind
    reached = reduce(lambda a, r: a | ((F.col("kind") == r["like"]) & (F.col("score") >= (r.least + (r.least if r.below is None else r.below)) / 2)), rows, F.lit(False))
    return scored.where("real and not in_base and kind is not null").where(reached).select("row", "source", "start", "end", "kind", "score")


def best_of_overlapping(added: DataFrame) -> DataFrame:
    """Of spans that overlap the one with the best score, then the longer, then the first; then the best of those left."""
    before = Window.partitionBy("row").orderBy("start", "end", "source").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("row").orderBy("start", "end", "source").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce((F.max("end").over(before) <= F.col("start")).cast("int"), F.lit(1))
    chains = added.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(upto))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("badness"), (F.col("start") - F.col("end")).alias("minus_size"), "start", "end", "kind")))
    taken = F.aggregate(
        F.col("ranked"), F.filter(F.col("ranked"), lambda s: F.lit(False)),
        lambda kept, s: F.when(F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(F.concat(kept, F.array(s))),
    )
    picked = chains.groupBy("row", "chain").agg(ranked.alias("ranked")).select("row", F.explode(taken).alias("s"))
    return picked.select("row", "s.start", "s.end", "s.kind")


def find(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in each row's whole text.

    Returns key, ``base`` and ``spans``: arrays of struct<start, kind, end> by start,
    then kind (code points, end exclusive; ``kind`` as its number in KINDS). ``spans``
    holds all base spans and those that the trees add; added spans overlap neither
    base spans nor each other. A null or empty text has none; repeated rows get equal
    results; an empty table gives an empty table. Other columns are not read. Without
    examples of both classes the trees add nothing.
    """
    rows = docs.select(F.col(key), text_of(text_col).alias("text"))
    found = proposals(rows, "text").select(F.monotonically_increasing_id().alias("row"), F.xxhash64(F.col(key), "text").alias("print"), F.col(key).alias("key"), "spans")
    found = written(found, "pii-proposals")
    spans = positioned(found)
    right = reduce(lambda a, k: a | ((F.col("source") == k) & valid(k, F.col("found"))), BASE, F.lit(False))
    spans = spans.where(right | F.col("source").isin(*WIDE)).withColumn("is_base", F.col("source").isin(*BASE))
    spans = written(spans.withColumn("in_base", overlapping(spans, F.col("is_base"))), "pii-spans")
    added = best_of_overlapping(selected(with_features(spans.where("not is_base").select(*SPAN))))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    all_ = spans.where("is_base").select("row", "start", "end", F.col("source").alias("kind"), F.lit(True).alias("is_base")).unionByName(added.select("row", "start", "end", "kind", F.lit(False).alias("is_base")))
    all_ = all_.select("row", "is_base", F.struct("start", number.alias("kind"), "end").alias("span"))
    lists = all_.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"), F.sort_array(F.collect_list(F.when(F.col("is_base"), F.col("span")))).alias("base"))
    none = F.array().cast(lists.schema["spans"].dataType)
    return found.select("row", "key").join(lists, "row", "left").select(F.col("key").alias(key), F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def is_kind(number: int):
    return lambda span: span["kind"] == number


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, spans: Column, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of ``spans`` (sorted) replaced by its kind in brackets.

    Overlapping base spans are covered by one replacement each, from the later of
    its start and the end of those before.
    """
    names = F.array(*map(F.lit, KINDS))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    text = F.col(text_col)
    step = lambda a, s: F.struct(
        F.when(s["end"] > a["at"], F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int")), F.lit("["), F.get(names, s["kind"]), F.lit("]"))).otherwise(a["out"]).alias("out"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    return docs.withColumn(text_col, F.aggregate(spans, begin, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text)))))

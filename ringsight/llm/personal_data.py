"""Personal data by fixed patterns and by bootstrapped contextual extraction, in SQL functions only.

Base spans come from four regular expressions with their checks. They seed a bootstrap: every
token with a digit or an @ is an instance (numbers with one space between them are one), the words around
it are its lexical patterns. Pattern and
instance scores are computed in turns on their graph. A pattern's precision is its seeds and found
instances against these, its known negatives (plain numbers, dates, times) and a small part of
its unknown instances, which are evidence for neither side; few seeds lower it. An instance is
found by several patterns together: its score is 1 less the product of what each leaves open,
and it rises as the patterns do. Instances that reach the threshold are identifiers the
expressions don't know.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ringsight.llm.common import free_name, let, running, stored

KINDS = ("email", "ip", "card", "phone", "learned")
ROUNDS = 3
CONFIDENCE = 0.9  # of an accepted pattern's precision and of a learned instance's score
SUPPORT = 3  # distinct seed instances that a pattern must have met
UNKNOWN = 0.1  # of an instance that is neither a seed nor a negative, as evidence against a pattern
# Instances that are known to be none: short or grouped numbers, amounts, dates, times and ordinals.
NEGATIVE = (
    r"^(?:[0-9]{1,4}|[0-9]{1,3}(?:[.,][0-9]{3})*(?:[.,][0-9]{1,2})?%?|[0-9]+[.,][0-9]+%?|[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}"
    r"|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?|[0-9]+(?:st|nd|rd|th))$"
)
BLOCK = 4096  # characters of a text looked at together
CONTEXT = 80  # characters looked at on either side
PUNCTUATION = "\"'`.,;:!?()[]{}<>|*#$%&=~^/\\_-"

# The same matches as the plain expressions: a run is entered at its start (or where the last
# match ended) and possessive quantifiers never give characters back, so that long runs cost
# one pass. [\x20-] etc. as given.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this can't hold a valid match.
GATES = {
    "email": "instr({t}, '@') > 0",
    "ip": r"{t} rlike '[0-9]\\.[0-9]'",
    "card": r"{t} rlike '[0-9](?:[\\x20-]?[0-9]){{15}}'",
    "phone": "instr({t}, '+') > 0",
}
NUMBER = r"[(+]*+[0-9][0-9().+/-]*+(?![^\x20\x09-\x0D,;:!?])"
# Two numbers or more, as far as they go, or one token.
TOKEN = (
    rf"(?<![^\x20\x09-\x0D])(?:{NUMBER}(?:\x20{NUMBER})++[,;:!?]*+(?![^\x20\x09-\x0D])"
    r"|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
)
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])){3}$"
SPAN = "array<struct<k:int,s:int,e:int>>"


def _digits(m: Column) -> Column:
    return F.translate(m, " -().+", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i, 1).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(OCTETS)
    d = _digits(m)
    if kind == "phone":
        return F.length(d).between(8, 15)
    return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))


def _walk(text: Column, pattern: str) -> Column:
    """``array<struct<a, b, m, p, q>>``: every match ``m`` with its length ``b``, the text ``p`` before it
    (length ``a``) back to the last match, and the text ``q`` after it. One element without ``m`` ends it."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    return F.zip_with(
        pieces, matches, lambda p, m: F.struct(F.length(p).alias("a"), F.length(m).alias("b"), m.alias("m"), p.alias("p"))
    )


def _starts(walked: Column) -> Column:
    """Where each element of ``_walk`` begins."""
    return running(F.transform(walked, lambda x: x["a"] + F.coalesce(x["b"], F.lit(0))))


def _spans(text: Column, kind: str, gate: str) -> Column:
    """Spans of the valid matches of one kind, in code points, end exclusive."""
    k = KINDS.index(kind)
    empty = F.array().cast(SPAN)

    def spans(walked: Column) -> Column:
        placed = F.zip_with(walked, _starts(walked), lambda x, at: F.struct((at + x["a"]).alias("s"), x["b"].alias("b"), x["m"].alias("m")))
        good = F.filter(placed, lambda x: x["m"].isNotNull() & F.coalesce(_valid(kind, x["m"]), F.lit(False)))
        return F.transform(good, lambda x: F.struct(F.lit(k).alias("k"), x["s"].alias("s"), (x["s"] + x["b"]).alias("e"))).cast(SPAN)

    return F.when(F.expr(gate), let(_walk(text, PATTERNS[kind]), spans)).otherwise(empty)


def base_spans(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the base spans of column ``text`` (not null) as ``out``, by kind, then start."""
    parts = [_spans(F.col(text), kind, GATES[kind].format(t=f"`{text}`")) for kind in KINDS[:-1]]
    return docs.withColumn(out, F.concat(*parts))


def _context(piece: Column, last: bool) -> Column:
    near = F.substring(piece, -CONTEXT, CONTEXT) if last else F.substring(piece, 1, CONTEXT)
    flat = F.trim(F.regexp_replace(F.lower(F.translate(near, "\t\n\x0b\x0c\r", "     ")), r"[^\p{L}\p{N} ]|\x20+(?=\x20)", ""))
    return F.substring_index(flat, " ", -2 if last else 2)


def _tokens(text: str, base: str) -> Column:
    """Tokens with digits or @, and runs of numbers: trimmed span, token, the two words on either side, and whether it is (in) a base span."""
    kind = "array<struct<s:int,e:int,token:string,left:string,right:string,seed:boolean>>"
    base_of = F.col(base)
    # The base spans that reach into each block of the text, so that a token meets only those near it.
    blocks = F.transform(
        F.sequence(F.lit(0), (F.length(text) / BLOCK).cast("int")),
        lambda i: F.filter(base_of, lambda b: (b["s"] < (i + 1) * BLOCK) & (b["e"] > i * BLOCK)),
    )

    def tokens(walked: Column, after: Column, near: Column) -> Column:
        placed = F.zip_with(walked, _starts(walked), lambda x, at: F.struct((at + x["a"]).alias("s"), x["p"].alias("p"), x["m"].alias("m")))
        both = F.zip_with(placed, after, lambda x, q: F.struct(x["s"].alias("s"), x["p"].alias("p"), x["m"].alias("m"), q.alias("q")))
        bare = F.transform(F.filter(both, lambda x: x["m"].isNotNull()), lambda x: F.struct(
            (x["s"] + F.length(x["m"]) - F.length(F.ltrim(x["m"], F.lit(PUNCTUATION)))).alias("s"),
            F.btrim(x["m"], F.lit(PUNCTUATION)).alias("token"), x["p"].alias("p"), x["q"].alias("q"),
        ))
        ended = F.transform(F.filter(bare, lambda x: x["token"] != ""), lambda x: F.struct(
            x["s"].alias("s"), (x["s"] + F.length(x["token"])).alias("e"), x["token"].alias("token"), x["p"].alias("p"), x["q"].alias("q"),
        ))

        def seed(x: Column) -> Column:
            first = (x["s"] / BLOCK).cast("int")
            reached = F.slice(near, first + 1, ((x["e"] - 1) / BLOCK).cast("int") - first + 1)
            return F.exists(reached, lambda bs: F.exists(bs, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))

        return F.transform(ended, lambda x: F.struct(
            x["s"].alias("s"), x["e"].alias("e"), x["token"].alias("token"), _context(x["p"], True).alias("left"),
            _context(x["q"], False).alias("right"), seed(x).alias("seed"),
        )).cast(kind)

    after = let(F.split(F.col(text), TOKEN, -1), lambda pieces: F.slice(pieces, F.lit(2), F.size(pieces)))
    found = let(_walk(F.col(text), TOKEN), lambda w: let(after, lambda q: let(blocks, lambda near: tokens(w, q, near))))
    return F.when(F.col(text).rlike("[0-9@]"), found).otherwise(F.array().cast(kind))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, base, tokens)`` of each row, stored; ``key`` is a hash of the text."""
    given = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    spanned = base_spans(given, "text", "base")
    return stored(spanned.select("doc_id", F.xxhash64("text").alias("key"), "base", _tokens("text", "base").alias("tokens")))


def learned_instances(scanned: DataFrame) -> DataFrame:
    """``(instance)``: lower-cased tokens that accepted patterns point at and that are no seeds."""
    seen = scanned.select(F.explode("tokens").alias("t")).select(F.lower("t.token").alias("instance"), "t.left", "t.right", "t.seed")
    word = lambda c, n: F.element_at(F.split(c, " "), n)
    pattern = F.array(
        F.when(F.instr("left", " ") > 0, F.concat(F.lit("L2:"), F.col("left"))),
        F.when(F.instr("right", " ") > 0, F.concat(F.lit("R2:"), F.col("right"))),
        F.when((F.col("left") != "") & (F.col("right") != ""), F.concat(F.lit("LR:"), word(F.col("left"), -1), F.lit("|"), word(F.col("right"), 1))),
    )
    # One edge for a pattern and an instance, however often they meet.
    edges = stored(
        seen.select("instance", "seed", F.explode(F.array_compact(pattern)).alias("pattern"))
        .groupBy("pattern", "instance").agg(F.max(F.col("seed").cast("int")).alias("seed"))
    )
    fixed = edges.groupBy("instance").agg(F.max("seed").alias("seed")).withColumn(
        "negative", ((F.col("seed") == 0) & F.col("instance").rlike(NEGATIVE)).cast("int")
    )
    score = stored(fixed.select("instance", "seed", "negative", F.col("seed").cast("double").alias("score")))
    for _ in range(ROUNDS):
        for_it, open_ = F.sum("score"), F.sum(F.when(F.col("negative") == 0, 1 - F.col("score")).otherwise(0.0))
        patterns = (
            edges.select("pattern", "instance").join(score, "instance").groupBy("pattern")
            .agg(for_it.alias("found"), F.sum("seed").alias("seeds"), F.sum("negative").alias("negatives"), open_.alias("open"))
            .where(F.col("seeds") >= SUPPORT)
            .withColumn("precision", F.round(F.col("found") / (F.col("found") + F.col("negatives") + UNKNOWN * F.col("open")), 9))
            .where(F.col("precision") >= CONFIDENCE)
            .select("pattern", (F.col("precision") * F.col("seeds") / (F.col("seeds") + 1)).alias("confidence"))
        )
        # An instance has few patterns that are accepted: all but rare ones end in the aggregation before the shuffle.
        left_open = edges.select("pattern", "instance").join(patterns, "pattern").groupBy("instance").agg(
            F.round(F.exp(F.sum(F.log1p(-F.col("confidence")))), 9).alias("left_open")
        )
        score = stored(
            fixed.join(left_open, "instance", "left").select(
                "instance", "seed", "negative",
                F.when(F.col("seed") == 1, 1.0).when(F.col("negative") == 1, 0.0)
                .otherwise(1 - F.coalesce("left_open", F.lit(1.0))).alias("score"),
            )
        )
    return score.where((F.col("seed") == 0) & (F.col("score") >= CONFIDENCE)).select("instance")


def learned_spans(scanned: DataFrame) -> DataFrame:
    """``(doc_id, key, learned)``: the spans of learned instances, for the documents that have some."""
    at = scanned.select("doc_id", "key", F.explode("tokens").alias("t")).where("not t.seed").select(
        "doc_id", "key", F.lower("t.token").alias("instance"), F.struct(F.lit(4).alias("k"), "t.s", "t.e").alias("span")
    )
    # A set per document and text: repeated rows give the same spans.
    return at.join(learned_instances(scanned), "instance").groupBy("doc_id", "key").agg(
        F.sort_array(F.collect_set("span")).cast(SPAN).alias("learned")
    )


def _said(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts of each kind, digest of the base spans, and all spans.

    A null text counts as empty; an empty one has no spans and the digest of the empty string.
    Repeated rows give equal rows; a null doc_id is carried through. Other columns are ignored.
    """
    scanned = scan(docs)
    more = learned_spans(scanned).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "learned")
    every = scanned.select("doc_id", "key", "base").join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("bigint")
    base = _said(F.col("base"))
    extra = F.coalesce("learned", F.array().cast(SPAN))
    return every.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:-1])],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        _said(F.concat("base", extra)).alias("spans"), F.size(extra).cast("bigint").alias("n_learned"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; ``n_chars``, if there, is counted anew.

    Null texts stay null. Overlapping spans become one mark, that of the first.
    """
    text, base, key, learned, fresh = (free_name(docs, f"_{n}") for n in ("text", "base", "key", "learned", "fresh"))
    more = learned_spans(scan(docs)).select(F.col("doc_id").alias(f"{key}_id"), F.col("key").alias(f"{key}_hash"), F.col("learned").alias(learned))
    given = base_spans(docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit(""))), text, base).withColumn(key, F.xxhash64(text))
    joined = given.join(more, F.col("doc_id").eqNullSafe(F.col(f"{key}_id")) & (F.col(key) == F.col(f"{key}_hash")), "left")
    by_start = F.array_sort(
        F.transform(F.concat(F.col(base), F.coalesce(F.col(learned), F.array().cast(SPAN))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))
    )
    name = lambda k: F.element_at(F.array(*[F.lit(f"[{x.upper()}]") for x in KINDS]), k + 1)
    blocks = F.transform(F.sequence(F.lit(0), (F.length(text) / BLOCK).cast("int")), lambda i: F.substr(F.col(text), i * BLOCK + 1, F.lit(BLOCK)))

    def marked_text(spans: Column, parts: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            first = (start / BLOCK).cast("int")
            near = F.array_join(F.slice(parts, first + 1, (end / BLOCK).cast("int") - first + 1), "")
            return F.substr(near, start - first * BLOCK + 1, end - start)

        before = running(F.transform(spans, lambda x: x["e"]), F.greatest)
        placed = F.zip_with(spans, before, lambda x, at: F.struct(at.alias("at"), x["s"].alias("s"), x["k"].alias("k")))
        marked = F.transform(F.filter(placed, lambda x: x["s"] >= x["at"]), lambda x: F.concat(cut(x["at"], x["s"]), name(x["k"])))
        end = F.array_max(F.transform(spans, lambda x: x["e"]))
        return F.array_join(F.concat(marked, F.array(cut(end, F.length(text)))), "")

    rebuilt = let(by_start, lambda spans: let(blocks, lambda parts: marked_text(spans, parts)))
    changed = joined.withColumn(fresh, F.when(F.col("text").isNull(), F.lit(None)).when((F.size(base) > 0) | F.col(learned).isNotNull(), rebuilt).otherwise(F.col(text)))
    out = []
    for field in docs.schema:
        c = F.col(f"`{field.name}`")
        if field.name == "text":
            c = F.col(fresh).alias("text")
        elif field.name == "n_chars":
            c = F.coalesce(F.length(fresh).cast(field.dataType), c).alias("n_chars")
        out.append(c)
    return changed.select(*out)

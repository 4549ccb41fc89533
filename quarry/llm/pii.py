"""Personal data in texts: patterns of the base kinds, and lexical patterns learnt from them.

Base spans come from one regular expression for each kind, scanned left to right without overlaps. Beside them, tokens
that hold digits or an @ are candidate instances; those of two well-known formats (access key ids, 40 hexadecimal digits)
are seeds of a kind of their own, ``secret``. Lexical patterns of an instance are the two words and the one word before
it, a name that it is assigned to (``name=`` or ``name:``), and the class of characters that a long mixed one consists of.

Seeds and patterns are scored in turns on the graph of distinct patterns and instances. A pattern's score for a kind is
the share of that kind among its labelled instances, where each unlabelled one counts a quarter against it; a pattern
that scores high and rests on several different instances labels the others that look like the kind. These count as
instances in the next round, so new patterns come from them. In the end each candidate after a pattern that holds becomes
a span of its kind.

Positions count code points, ends are exclusive. Null texts count as empty. Repeated rows each get their spans; copies
of an instance count once, and ties between kinds go to the first. Rows keep no text on the way, so long texts are read
once, in time that grows with the power of 1.5 of their matches; what is exchanged are candidate tokens only. An empty
table gives an empty result. Other columns stay, whatever their names; ``base`` and ``spans`` get another name where the
table has such columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.common import SPACE, let

#: The kinds in the order of the output.
KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4

# Each scans the maximal run of its first part once: a match can only begin at the run's start or where the last ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Tokens that may be identifiers.
_TOKEN = rf"(?<![^{SPACE}])[^{SPACE}0-9@]*+[0-9@][^{SPACE}]*+"
#: Secrets of these formats are seeds.
_SECRETS = r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{40}|[0-9A-F]{40})$"

#: Different instances that a pattern must rest on, the score it must reach, how much an unlabelled instance counts
#: against it, and rounds.
MIN_SEEDS, MIN_SCORE, UNKNOWN, ROUNDS = 4, 0.75, 0.25, 3
#: Characters before a match that its context is taken from.
REACH = 64


def found(text: Column, pattern: str, context: int = 0) -> Column:
    """Matches as array of (s, e, m, l): start, end, match and, if asked for, the characters before it.

    The pieces between the matches and the matches themselves alternate, which gives the positions: within groups of
    as many matches as there are groups, and then over the groups.
    """
    item = "struct<s:int,e:int,m:string,l:string>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{item}>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        left = F.right(x["g"], F.lit(context)) if context else F.lit("")
        one = F.struct(start.alias("s"), (start + F.length(x["m"])).alias("e"), x["m"].alias("m"), left.alias("l"))
        return F.struct((start + F.length(x["m"])).alias("at"), F.concat(acc["all"], F.array(one)).alias("all"))

    def shifted(groups: Column) -> Column:
        before = F.aggregate(groups, F.array(F.lit(0)), lambda acc, g: F.concat(acc, F.array(F.element_at(acc, -1) + g["at"])))
        moved = lambda g, by: F.transform(g["all"], lambda x: F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["m"].alias("m"), x["l"].alias("l")))
        return let(before, lambda b: F.flatten(F.transform(groups, lambda g, i: moved(g, F.get(b, i)))))

    def walk(m: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m))
        pairs = F.zip_with(gaps, m, lambda g, x: F.struct(g.alias("g"), x.alias("m")))
        width = F.ceil(F.sqrt(F.size(m))).cast("int")
        grouped = let(pairs, lambda p: F.transform(F.sequence(F.lit(1), F.size(m), width), lambda i: F.aggregate(F.slice(p, i, width), zero, step)))
        return F.when(F.size(m) == 0, F.array().cast(f"array<{item}>")).otherwise(let(grouped, shifted))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _checks() -> dict:
    """By kind: a quick test of the text, the pattern, and what a match must fulfil."""
    part = "^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
    return {
        "email": (lambda t: F.instr(t, "@") > 0, _EMAIL, lambda m: F.lit(True)),
        "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), _IP, lambda m: F.forall(F.split(m, r"\."), lambda p: p.rlike(part))),
        "card": (lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), _CARD, lambda m: F.length(_digits(m)).between(13, 19) & F.call_function("luhn_check", _digits(m))),
        "phone": (lambda t: F.instr(t, "+") > 0, _PHONE, lambda m: F.length(_digits(m)).between(9, 15)),
    }


def base_matches(text: Column) -> Column:
    """Array of (kind, s, e, m, l) of all base kinds, in the order of kinds and starts: span, match, what is before it."""
    none = F.array().cast("array<struct<kind:int,s:int,e:int,m:string,l:string>>")

    def of_kind(k: int, may, pattern: str, valid) -> Column:
        spans = F.transform(F.filter(found(text, pattern, REACH), lambda x: valid(x["m"])), lambda x: F.struct(F.lit(k).alias("kind"), x["s"], x["e"], x["m"], x["l"]))
        return F.when(may(text), spans).otherwise(none)

    return F.concat(*[of_kind(k, *check) for k, check in enumerate(_checks().values())])


def base_spans(text: Column) -> Column:
    """Array of (kind, s, e) of all base kinds, in the order of kinds and starts."""
    return F.transform(base_matches(text), lambda x: F.struct(x["kind"], x["s"], x["e"]))


def masked(text: Column) -> Column:
    """The text with letters in place of the digits and at-signs of base matches; positions stay."""

    def of_kind(t: Column, may, pattern: str, valid) -> Column:
        def joined(m: Column) -> Column:
            hidden = F.transform(m, lambda x: F.when(valid(x), F.regexp_replace(x, "[0-9@]", "x")).otherwise(x))
            pieces = F.zip_with(F.split(t, pattern, -1), hidden, lambda g, x: F.concat(g, F.coalesce(x, F.lit(""))))
            return F.array_join(pieces, "")

        return F.when(may(t), let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), joined)).otherwise(t)

    def after(t: Column, checks: list) -> Column:
        return let(of_kind(t, *checks[0]), lambda x: after(x, checks[1:])) if checks else t

    return after(text, list(_checks().values()))


def _left(before: Column) -> Column:
    """Patterns of the two words and the one word before, lower case and with digits alike."""
    words = F.filter(F.split(F.lower(F.regexp_replace(before, "[0-9]", "0")), f"[{SPACE}]+"), lambda w: w != "")
    two = lambda w: F.when(F.size(w) >= 2, F.concat(F.lit("2 "), F.array_join(F.slice(w, -2, 2), " ")))
    one = lambda w: F.when(F.size(w) >= 1, F.concat(F.lit("1 "), F.element_at(w, -1)))
    return let(words, lambda w: F.array_compact(F.array(two(w), one(w))))


def character_class(token: Column) -> Column:
    """A name for what a long token that mixes digits and letters consists of, else null."""
    mixed = token.rlike(r"[0-9][^0-9]*[0-9][^0-9]*[0-9]") & token.rlike(r"[A-Za-z][^A-Za-z]*[A-Za-z][^A-Za-z]*[A-Za-z]")
    classes = {"hex": r"^(?:[0-9a-f]{12,}|[0-9A-F]{12,})$", "capitals": r"^[0-9A-Z]{12,}$", "letters": r"^[0-9a-z]{12,}$", "any": r"^[0-9A-Za-z_+/-]{16,}$"}
    name = None
    for k, pattern in classes.items():
        name = F.when(token.rlike(pattern), k) if name is None else name.when(token.rlike(pattern), k)
    return F.when(mixed, name)


_OCCURRENCE = "array<struct<s:int,e:int,token:string,pats:array<string>,kind:int>>"


def candidates(text: Column, matches: Column) -> Column:
    """Array of (s, e, token, pats, kind): base matches, and identifier-like tokens beside them, seeds or not (kind null)."""
    name = r"^[^\p{L}0-9@+(]*([\p{L}_][\p{L}0-9_.-]*[=:])(?=[^=:]*[0-9])"
    lead = r"^[^\p{L}0-9@+(]+"
    trail = r"[^\p{L}0-9)]+$"

    def unknown(x: Column) -> Column:
        def of_value(v: Column) -> Column:  # v: what follows a name, or the whole
            rest = F.regexp_replace(v, lead, "")
            token = F.regexp_replace(rest, trail, "")
            start = x["e"] - F.length(rest)
            assigned = F.regexp_extract(x["m"], name, 1)
            class_ = character_class(token)
            pats = F.concat(_left(x["l"]), F.array_compact(F.array(F.when(assigned != "", F.concat(F.lit("= "), F.lower(assigned))), F.concat(F.lit("~ "), class_))))
            return F.struct(start.alias("s"), (start + F.length(token)).alias("e"), F.lower(token).alias("token"), pats.alias("pats"), F.when(token.rlike(_SECRETS), F.lit(SECRET)).alias("kind"))

        return let(F.regexp_replace(x["m"], name, ""), of_value)

    def seed(b: Column) -> Column:
        return F.struct(b["s"], b["e"], F.lower(b["m"]).alias("token"), _left(b["l"]).alias("pats"), b["kind"])

    beside = let(masked(text), lambda t: found(t, _TOKEN, REACH))
    both = F.concat(F.transform(matches, seed), F.transform(beside, unknown))
    kept = F.filter(both, lambda c: (F.length(c["token"]) >= 4) & (F.size(c["pats"]) > 0) | c["kind"].isNotNull())
    return F.when(text.rlike("[0-9@]"), kept).otherwise(F.array().cast(_OCCURRENCE))


def shape(token: Column) -> Column:
    """Which kinds a token may be: an @ for emails, dots between digits for addresses, enough digits, or a mixture."""
    digits = F.length(_digits(token))
    return F.array(
        token.contains("@"),
        token.rlike(r"^[0-9]+(?:[.:][0-9a-f]+){2,}$"),
        (digits >= 8) & ~token.rlike(r"\p{L}"),
        (digits >= 6) & ~token.rlike(r"\p{L}"),
        (F.length(token) >= 8) & (digits >= 2) & token.rlike(r"\p{L}") & ~token.contains("@"),
    )


def learn(occurrences: DataFrame, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE, rounds: int = ROUNDS) -> DataFrame:
    """Patterns (pattern, kind) that score high, from occurrences (pats, token, kind or null)."""
    graph = common.written(occurrences.select(F.explode("pats").alias("pattern"), "token", "kind").groupBy("pattern", "token").agg(F.min("kind").alias("kind")), "graph")
    labelled, patterns = graph, None
    for turn in range(rounds):
        of_kind = [F.count(F.when(F.col("kind") == k, 1)).alias(f"c{k}") for k in range(len(KINDS))]
        counts = labelled.groupBy("pattern").agg(*of_kind, F.count(F.lit(1)).alias("total"))
        best = F.greatest(*[F.struct(F.col(f"c{k}").alias("n"), F.lit(-k).alias("k")) for k in range(len(KINDS))])
        known = sum((F.col(f"c{k}") for k in range(len(KINDS))), F.lit(0))
        score = F.col("best.n") / (known + UNKNOWN * (F.col("total") - known))
        held = counts.withColumn("best", best).where(F.col("best.n") >= min_seeds).withColumn("score", score).where(F.col("score") >= min_score)
        patterns = common.written(held.select("pattern", (-F.col("best.k")).alias("of"), "score"), "patterns")
        if turn == rounds - 1:
            break
        reached = common.bounded_join(graph.where("kind is null").drop("kind"), patterns, ["pattern"]).where(F.get(shape(F.col("token")), F.col("of")))
        accepted = reached.groupBy("token").agg(F.max(F.struct("score", (-F.col("of")).alias("k"))).alias("b")).select("token", (-F.col("b.k")).alias("new"))
        accepted = common.written(accepted, "instances")
        labelled = common.bounded_join(graph, accepted, ["token"]).select("pattern", "token", F.coalesce("kind", "new").alias("kind"))
    return patterns.select("pattern", F.col("of").alias("kind"))


def extract(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``base`` and ``spans``: arrays of (kind, s, e) ordered by kind and start; ``spans`` holds the learnt ones too.

    Without ``keep_text`` the text column is dropped before rows are written between the passes.
    """
    base, uid, cand, out, pair = common.fresh(df, "base", "_uid", "_cand", "spans", "_pii")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = lambda m: F.transform(m, lambda x: F.struct(x["kind"], x["s"], x["e"]))
    both = let(t, lambda x: let(base_matches(x), lambda m: F.struct(plain(m).alias("b"), candidates(x, m).alias("c"))))
    kept = [F.col(f"`{c}`") for c in df.columns if keep_text or c != text]
    rows = df.withColumn(pair, both).select(*kept, F.col(f"{pair}.b").alias(base), F.col(f"{pair}.c").alias(cand), F.monotonically_increasing_id().alias(uid))
    rows = common.written(rows, "pii")
    seen = rows.where(F.size(cand) > 0).select(F.col(uid).alias("uid"), F.inline(cand))
    patterns = common.written(learn(seen.select("pats", "token", "kind")), "contexts")
    seeds = seen.where(F.col("kind") == SECRET).select("uid", "kind", "s", "e")
    each = seen.where("kind is null").select("uid", "s", "e", "token", F.explode("pats").alias("pattern"))
    new = common.bounded_join(each, patterns, ["pattern"]).where(F.get(shape(F.col("token")), F.col("kind")))
    one = new.groupBy("uid", "s", "e").agg(F.min("kind").alias("kind")).select("uid", "kind", "s", "e").union(seeds)
    more = one.groupBy("uid").agg(F.collect_set(F.struct("kind", "s", "e")).alias("more"))
    (added,) = common.fresh(rows, "_more")
    joined = rows.join(more.select(F.col("uid").alias(f"{uid}r"), F.col("more").alias(added)), F.col(uid) == F.col(f"{uid}r"), "left")
    apart = F.filter(F.col(added), lambda x: ~F.exists(F.col(base), lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
    spans = F.when(F.col(added).isNull(), F.col(base)).otherwise(F.array_sort(F.array_union(F.col(base), apart)))
    return joined.withColumn(out, spans).drop(f"{uid}r", added, uid, cand)


def written_out(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    out = extract(docs, keep_text=False)
    count = lambda k: F.size(F.filter(F.col("base"), lambda x: x["kind"] == k)).cast("bigint")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:SECRET])]
    return out.select("doc_id", *counts, F.sha2(written_out("base"), 256).alias("base_sha256"), written_out("spans").alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))

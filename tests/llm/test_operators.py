"""Each corpus operator against brute force on a small fixture that holds nulls, blanks, ties, repeats and long texts."""

import hashlib
import re
from collections import Counter

import pytest

from quarry.llm import byte_bpe, common, embeddings, line_dedup, minhash, mixing, pii, quality, queries, toxicity, urls

from .conftest import documents

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = {c: "1" for c in ("ids", "kept", "gone", "rk", "n_tokens", "host", "rule", "score", "base", "spans", "_rk", "label", "uid", "n_lines")}


def clashing(df):
    """The table with extra columns whose names operators use."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(v) for c, v in CLASH.items()})


def test_all_queries_take_empty_tables(spark, empty):
    for name, query in queries.queries().items():
        assert query(spark, empty).count() == 0, name


# 1 -----------------------------------------------------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    luhn = lambda x: sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(x))) % 10 == 0
    ok = [lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")), lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15]
    return [f"{pii.KINDS[k]}:{m.start()}:{m.end()}" for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if ok[k](m[0])]


HARD = [
    "a@b.c%d@e.f x@y@z.org a.b+c@d-e.co.uk. foo@bar", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.2.3 1.2.3.256 7.7.7.7", "4111 1111 1111 1111 4111-1111-1111-1111x 4111  1111 1111 1111 12345678901234567890",
    "+1 (988) 555-2485 ++49 170 1234567 +1 2 +(12) +123456789012345678", "😀 a@b.de 日本 +49 (30) 123456 é 10.0.0.1", "9" * 20000, "a." * 8000, "1." * 8000, "+1 " + "(" * 9000, "@" * 500, "", None,
]


def test_pii_base(spark):
    df = clashing(spark.createDataFrame(list(enumerate(HARD)), "doc_id bigint, text string"))
    got = {r.doc_id: r for r in pii.extract(df).collect()}
    for i, t in enumerate(HARD):
        spans = [f"{pii.KINDS[x.kind]}:{x.s}:{x.e}" for x in next(v for k, v in got[i].asDict().items() if k == "base_")]
        assert spans == base_spans(t or ""), t[:60]


def test_pii_contexts_find_more(spark):
    rows = [(i, f"so my phone number is +49 30 123456{i:02d} ok") for i in range(30)] + [(100, "well, my phone number is 555-01234-77 ok"), (101, "in the year of 555-01234-77 gone")]
    got = {r.doc_id: r.spans for r in pii.extract(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [(x.kind, x.s, x.e) for x in got[100]] == [(3, 25, 37)]
    assert got[101] == [] and len(got[0]) == 1


def test_pii_instances_induce_patterns(spark):
    """Seeds induce the name that they are assigned to; values of that name become instances and induce what precedes them."""
    rows = [(i, f'x{i} token="{i:040x}" y') for i in range(10, 40)] + [(100 + i, f"kk{i} my login is token=zebra{i:02d}fish; k") for i in range(8)] + [(200, "now my login is tiger77horse ok"), (201, "v. 77a")]
    got = {r.doc_id: r.spans for r in pii.extract(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    at = lambda i, v: [(pii.SECRET, t.index(v), t.index(v) + len(v)) for j, t in rows if j == i]
    assert [tuple(x) for x in got[100]] == at(100, "zebra00fish") and [tuple(x) for x in got[10]] == at(10, f"{10:040x}")
    assert [tuple(x) for x in got[200]] == at(200, "tiger77horse") and got[201] == []


def test_pii_many_matches(spark):
    """Work must not grow with the square of a text's matches."""
    import time

    text = " ".join(f"u{i}@h{i}.org 10.0.{i % 256}.{i % 200}" for i in range(30000))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.time()
    (row,) = pii.extract(df, keep_text=False).collect()
    assert [f"{pii.KINDS[x.kind]}:{x.s}:{x.e}" for x in row.base] == base_spans(text) and time.time() - began < 30


def test_pii_query(spark, docs):
    import hashlib

    rows = pii.op1_pii(spark, docs).collect()
    want = Counter()
    for d, t, *_ in documents():
        spans = base_spans(t or "")
        want[(d, *[sum(x.startswith(k) for x in spans) for k in pii.KINDS[:4]], hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == want


# 2 -----------------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    rows = ["http://Example.COM/en/x?q#f", "https://www.example.com/en/", "http://a.net/es/1", "http://a.net/de/", "x.com/en/", None, "", "http://com/", "http://example.com", "http://notexample.com/en/", "a://b.net/fr/?x://y", "http://ÄB.com/p"]
    df = clashing(spark.createDataFrame(list(enumerate(rows)), "page_id int, url string"))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert [got[i].rule for i in range(12)] == ["example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, "com/", None, "com/", "net/fr/", "com/"]
    assert (got[0].host, got[0].path) == ("example.com", "/en/x") and got[4].host == got[5].path == "" and got[11].host == "Äb.com"
    assert {got[i].verdict for i in range(12)} <= {"allow", "block"} and got[0].verdict == "block" and got[1].verdict == "allow"


def test_url_model_learns():
    import numpy as np

    hosts = [f"{'casino' if i % 2 else 'school'}{i}.org" for i in range(200)]
    model = urls.fit(hosts, ["/"] * 200, np.array([i % 2 for i in range(200)]))
    row, bucket, value = urls.grams(["casino999.org", "school999.org"], ["/", "/"])
    z = np.bincount(row, value * model[0][bucket], minlength=2) + model[1]
    assert z[0] > 0 > z[1]


def url_rule(url):
    """(host, path, rule) by the contract."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, max(fits, key=len, default=None)


def test_url_query(spark, tmp_path):
    """Hosts, paths, rules and their verdicts by definition; the model agrees with rules that it has not seen."""
    import random
    import zlib

    rng = random.Random(6)
    rows = [f"http{'s' * (i % 2)}://{rng.choice(['www.', 'm.', 'Blog.', ''])}w{rng.randrange(60)}.example.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['en', 'de', 'fr', 'es'])}/{i}{rng.choice(['', '?p=1', '#top', '/'])}" for i in range(1500)]
    rows += [None, "", "no scheme", "http://", "x://" + "a" * 20000 + ".com/" + "b" * 20000, "http://a.com/\n/en", rows[0], rows[0]]
    spark.createDataFrame(list(enumerate(rows)), "page_id int, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in urls.op2_url_filters(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, u in enumerate(rows):
        assert (got[i].host, got[i].path, got[i].rule) == url_rule(u) and got[i].verdict in ("allow", "block")
        assert got[i].rule is None or got[i].verdict == urls.RULES[got[i].rule]
    known = [(u, urls.RULES[url_rule(u)[2]], zlib.crc32(u.encode()) % 5 == 0) for u in rows[:1500] if url_rule(u)[2]]
    labelled = spark.createDataFrame([(u, v) for u, v, held in known if not held], "url string, verdict string")
    out = urls.judge(spark.createDataFrame([(u, v) for u, v, held in known if held], "url string, want string"), rules={}, labelled=labelled)
    hits = [r.verdict == r.want for r in out.collect()]
    assert len(hits) > 100 and sum(hits) / len(hits) > 0.97


# 3 -----------------------------------------------------------------------------------------------------------------


def counts(text):
    w = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, cover = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            cover.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(spark, docs):
    from pyspark.sql import functions as F

    extra = [(900, "a b\n\na b\n c\x1fd #*$\n" * 9, "en", "s0", 1), (901, "x y z " * 100, "en", "s0", 1)]
    df = clashing(spark.read.parquet(f"{docs}/documents.parquet").union(spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string, n_chars bigint")))
    out, f, kept = quality.judge(df)
    rows = out.select("text", f, F.col(kept).alias("ok"), quality.base_failed(f).alias("failed")).collect()
    assert len(rows) == len(documents()) + 2
    for r in rows:
        want = counts(r.text)
        assert tuple(r[1][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r.failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (r.failed and r.ok)
    assert quality.keep_good(df).columns == df.columns


def test_quality_fences_hold_against_a_tenth_of_junk(spark):
    import random

    rng = random.Random(3)
    words = [w * k for w in ("ab", "cde", "fghi", "jklmno") for k in (1, 2)]
    junk = lambda w: w + "### of***"
    rows = []
    for i in range(600):
        bad = i % 10 == 0
        text = " ".join(f"{rng.choice(words)}{i}x{j}" for j in range(60))
        rows.append((i, " ".join(map(junk, text.split())) if bad else text, "en", f"s{i % 2}" if not bad else "s0", bad))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, bad boolean")
    kept = {r.doc_id for r in quality.keep_good(df).collect()}
    assert kept == {i for i, *_, bad in rows if not bad}


def test_sketch_quantiles(spark):
    df = spark.range(1, 2001).selectExpr("'a' as g", "id")
    from pyspark.sql import functions as F

    sketch = df.select("g", F.lit("m").alias("measure"), F.floor(F.ln("id") / F.ln(F.lit(quality.GAMMA))).cast("int").alias("bucket")).groupBy("g", "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))
    got = quality.quantiles(sketch, ["g"], {"q50": 0.5, "q95": 0.95}).first()
    assert got.q50 == pytest.approx(1000, rel=0.02) and got.q95 == pytest.approx(1900, rel=0.02)


def test_quality_query(spark, tmp_path):
    """Counts, base rule and fences of the query against a version in plain Python, and on groups of any size."""
    import math
    import random

    rng = random.Random(8)
    rows = []
    for i in range(900):
        lang, source = ("en", f"s{i % 3}") if i % 10 else ("de", "few")
        words = ["w" * rng.randint(3, 9) for _ in range(rng.randint(25, 60))]
        if i % 11 == 0:
            words = [w + "###" for w in words]
        rows.append((i, "\n".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10)), lang, source, 0))
    rows += [(901, None, None, None, None), (902, "", "en", "s0", 0), (903, "one text of a group of its own " * 4, None, "alone", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in quality.op3_quality_rules(spark, str(tmp_path)).collect()}

    def values(t):
        w, chars, symbols, dup, repeat = counts(t)
        lines = sum(1 for x in (t or "").split("\n") if SPACE.search(x))
        return (chars / max(w, 1), symbols / max(w, 1), dup / max(lines, 1), repeat / max(w, 1))

    failed = {d: (c := counts(t))[0] < 20 or 100 * c[4] > 30 * c[0] for d, t, *_ in rows}
    bucket = lambda v: math.floor(math.log(v) / math.log(quality.GAMMA)) if v > 0 else None

    def sketch(of):
        return [Counter(bucket(values(t)[m]) for d, t, lang, source, _ in rows if not failed[d] and of(lang, source)) for m in range(4)]

    def merge(fine, coarse, prior=100.0):
        return [{b: a.get(b, 0) + prior * c.get(b, 0) / sum(c.values()) for b in {*a, *c}} for a, c in zip(fine, coarse, strict=True)]

    def fence(s, m):
        order, total, at, q = sorted(s, key=lambda b: (b is not None, b or 0)), sum(s.values()), 0.0, []
        for b in order:
            at += s[b]
            q += [quality.GAMMA ** (b + 0.5) if b is not None else 0.0] * (sum(at >= x * (1 - 1e-9) * total for x in (0.25, 0.5, 0.75)) - len(q))
        lower, pad = list(quality.MEASURES.values())[m]
        up, down = quality.TAIL * (q[2] - q[1]), quality.TAIL * (q[1] - q[0])
        return (q[1] - down - max(4 * down, pad) if lower else -1.0, q[1] + up + max(4 * up, pad))

    whole, held = sketch(lambda *_: True), {}
    for group in {(lang, source) for d, _, lang, source, _ in rows if not failed[d]}:
        own = merge(sketch(lambda x, y, group=group: (x, y) == group), merge(sketch(lambda x, _, group=group: x == group[0]), whole))
        held[group] = [fence(s, m) for m, s in enumerate(own)]
    for d, t, lang, source, _ in rows:
        want = not failed[d] and all(lo <= v <= hi for v, (lo, hi) in zip(values(t), held[lang, source], strict=True))
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(t)
        assert (r.base_failed, r.kept) == (failed[d], want), (d, values(t))
    assert not any(got[i].kept for i in range(0, 900, 11)) and sum(got[i].kept for i in range(900)) > 750


# 4 -----------------------------------------------------------------------------------------------------------------


def line_oracle(rows, least=50):
    lines = {(d, t): [x for x in (t or "").split("\n") if x.encode().split()] for d, t in rows}
    windows, first = [], {}
    for (d, t), ls in lines.items():
        n = [len(x.encode().split()) for x in ls]
        for a in range(len(n)):
            for b in range(a, len(n)):
                if sum(n[a : b + 1]) >= least:
                    windows.append(((d is None, d or 0, t), a, b, tuple(ls[a : b + 1])))
                    break
            for z in range(a, -1, -1):
                if sum(n[z : a + 1]) >= least:
                    windows.append(((d is None, d or 0, t), z, a, tuple(ls[z : a + 1])))
                    break
    for key, a, _, c in windows:
        first[c] = min(first.get(c, (key, a)), (key, a))
    gone = {}
    for key, a, b, c in windows:
        if first[c] < (key, a):
            gone.setdefault((key[1] if not key[0] else None, key[2]), set()).update(range(a, b + 1))
    return gone


def test_line_dedup(spark, docs):
    df = spark.read.parquet(f"{docs}/documents.parquet")
    want = line_oracle([(r.doc_id, r.text) for r in df.collect()])
    got = line_dedup.dedup(clashing(df)).collect()
    source = {r.doc_id: r.text for r in df.collect() if r.doc_id is not None}
    assert len(got) == len(documents())
    for r in got:
        if r.doc_id is not None:
            assert set(r.gone or []) == want.get((r.doc_id, source[r.doc_id]), set()), r.doc_id
    assert sum(bool(r.gone) for r in got) >= 10
    kept = line_dedup.keep_new(df)
    assert kept.columns == df.columns and kept.where("doc_id = 0").first().text == source[0]


def test_cleaned_lines():
    assert line_dedup.cleaned("a\n\nb\nc", [1]) == ("a\n\nc", 3)
    assert line_dedup.cleaned("a\nb", [0, 1]) == ("", 2)


# 5, 8 --------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as public
    import tiktoken

    path = public.path("byte_bpe_50k.tiktoken")
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={}), byte_bpe.loaded(path, public.PATTERN)


def test_bpe_equals_tiktoken(reference):
    import random

    theirs, ours = reference
    rng = random.Random(3)
    alphabet = " \n\t'.=-_*aAeEsSthingon0123 é日ü½²ß\x1c\x85\xa0😀\u0558\u208f"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(4000)] + ["".join(rng.choice("ab") * rng.randint(1, 9) for _ in range(20)) for _ in range(2000)] + ["<|endoftext|> it's I'll 'S", "x" * 5000]
    for t in texts:
        ids = theirs.encode_ordinary(t)
        assert ours.encode(t) == ids and ours.count(t) == len(ids) and ours.decode(ids) == t
        assert ours.digest(t) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_offsets_and_split_characters(reference):
    _, ours = reference
    text = "né 日😀"
    ids = ours.encode(text)
    starts, ends = ours.offsets(text, ids)
    assert starts[0] == 0 and ends[-1] == len(text) and all(a < b for a, b in zip(starts, ends, strict=True))
    covered = {i for a, b in zip(starts, ends, strict=True) for i in range(a, b)}
    assert covered == set(range(len(text)))
    assert "\ufffd" in ours.decode(ids[:-1]) or ours.decode(ids[:-1]) + "😀" == text


def test_encode_and_decode_tables(spark, docs):
    df = clashing(spark.read.parquet(f"{docs}/documents.parquet"))
    back = byte_bpe.decode(byte_bpe.encode(df, offsets=True)).collect()
    assert len(back) == len(documents()) and all(r.decoded == (r.text or "") and len(r.starts) == len(r.ids) for r in back)


def test_length_histogram(spark):
    lengths = [0, 0, 3, 3, 3, 7, 20]
    df = spark.createDataFrame([(x, "ab"[i % 2]) for i, x in enumerate(lengths)], "n_tokens bigint, g string")
    from pyspark.sql import functions as F

    h = byte_bpe.length_histogram(df, by=F.col("g"))
    for r in h.where("whole").collect():
        assert (r.n_up_to, r.n_above) == (sum(x <= r.length for x in lengths), sum(x > r.length for x in lengths))
        assert r.truncated_tokens == sum(min(x, r.length) for x in lengths) and r.total_tokens == sum(lengths)
    assert h.where("not whole").agg(F.sum("n_docs")).first()[0] == len(lengths)
    got = {r.context_limit: r.truncated_tokens for r in byte_bpe.at_limits(h, [0, 1, 5, 8, 100]).collect()}
    assert got == {k: sum(min(x, k) for x in lengths) for k in (0, 1, 5, 8, 100)}


# 6 -----------------------------------------------------------------------------------------------------------------


def test_mixing(spark, docs):
    rows = mixing.op6_mixing(spark, docs).collect()
    source = {r[0]: r[3] for r in documents()}
    sizes = Counter()
    for r in documents():
        sizes[r[3]] += len(SPACE.findall(r[1] or ""))
    assert len(rows) == len(documents()) and sum(r.size for r in rows) == sum(sizes.values())
    order = ["s0", "s1", None]
    target = {s: 1.5 * sum(sizes.values()) * w / 8 for s, w in zip(order, (5, 2, 1), strict=True)}
    for _ in range(9):
        over = sum(max(t - 2 * sizes[s], 0) for s, t in target.items())
        free = [s for s in order if target[s] < 2 * sizes[s]]
        total = sum({"s0": 5, "s1": 2, None: 1}[s] for s in free)
        target = {s: min(t, 2 * sizes[s]) + (over * {"s0": 5, "s1": 2, None: 1}[s] / total if s in free else 0) for s, t in target.items()}
    taken = Counter()
    for r in rows:
        s = source[r.doc_id] if r.doc_id is not None else None
        assert r.target == pytest.approx(target[s]) and r.source_size == sizes[s] and r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.op6_mixing(spark, docs).collect()))


def test_mixed_documents_hold_the_words_taken(spark, docs):
    df = spark.read.parquet(f"{docs}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got = Counter()
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in out.collect():
        words = SPACE.findall(r.text)
        got[r.doc_id] += len(words)
        assert r.n_chars == len(r.text) and not Counter(words) - Counter(SPACE.findall(texts[r.doc_id]))
    rows, taken, _ = mixing.mix(df)
    want = Counter()
    ids = {r.uid: r.doc_id for r in rows.select("uid", "doc_id").collect()}
    for r in taken.collect():
        want[ids[r.uid]] += r.b - r.a
    assert got == +want
    dealt = mixing.mixed_documents(df, shard="shard")
    assert dealt.columns == [*df.columns, "shard"] and dealt.where("shard is null").count() == 0


def test_shards_draw_multinomial_counts(spark):
    """Each source's slots are dealt to the shards to the last one, by counts that vary as multinomial ones do."""
    import numpy as np

    plan = [("a", 256 * 40_000, 256 * 60_000.0), (None, 256 * 10_000 + 7, 256 * 5_000.0), ("c", 0, 0.0)]
    rows = mixing.slots(spark.createDataFrame(plan, "source string, source_size bigint, target double"), shard_slots=500).collect()
    assert Counter(r.source for r in rows) == {"a": 60_000, None: 5_000}
    assert {s: sum(r.words for r in rows if r.source == s) for s in ("a", None)} == {"a": 256 * 60_000, None: 256 * 5_000}
    for source, n in (("a", 60_000), (None, 5_000)):
        mine = sorted((r.slot, r.shard) for r in rows if r.source == source)
        assert [s for s, _ in mine] == list(range(n)) and [k for _, k in mine] == sorted(k for _, k in mine)
        drawn = np.bincount([k for _, k in mine], minlength=130)
        assert len(drawn) == 130 and 0.6 < drawn.var() / (n / 130 * (1 - 1 / 130)) < 1.6
    once = [r["index"] for r in rows if r["source"] == "a" and r["pass"] == 0]
    assert sorted(once) == list(range(40_000)) and once != sorted(once)


def test_permutations_are_bijections(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 30, 997):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.xxhash64(F.lit("k"))).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


# 7 -----------------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    import random

    rng = random.Random(1)
    words, bad = [f"word{i}" for i in range(300)], ["vile", "rotten", "scum"]

    def text(toxic):
        w = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        for _ in range(4 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        return " ".join(w)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df.where("doc_id < 400"), df.select("doc_id", "toxic").where("doc_id < 400"))
    out = toxicity.scored(clashing(df).union(clashing(spark.createDataFrame([(1000, None, 0), (1001, "", 0)], "doc_id bigint, text string, toxic int"))), model).collect()
    held = [r for r in out if 400 <= r.doc_id < 600]
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in held) / len(held) > 0.95
    blank = {r.score for r in out if r.doc_id >= 1000}
    assert len(blank) == 1 and 0 <= blank.pop() < 0.5


def test_toxicity_by_rare_pairs(spark, monkeypatch):
    import random

    rng = random.Random(4)

    def text(toxic):
        w = [rng.choice([f"word{i}" for i in range(50)]) for _ in range(40)]
        for at in (5, 15, 25):
            w[at : at + 2] = ["drown", "them"] if toxic else rng.choice([["drown", "word1"], ["them", "word2"], ["them", "drown"]])
        return " ".join(w)

    rows = [(i, text(i % 10 == 0), int(i % 10 == 0)) for i in range(240)]  # 12 toxic texts to learn from, each has the pair 3 times
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df.where("doc_id < 120"), df.select("doc_id", "toxic").where("doc_id < 120"))
    broadcast = {r.doc_id: r.score for r in toxicity.scored(clashing(df), model).collect()}
    assert all((broadcast[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 120)
    monkeypatch.setattr(toxicity, "BLOCK", 30)
    model.small = False
    joined = {r.doc_id: r.score for r in toxicity.scored(clashing(df), model).collect()}
    assert joined == pytest.approx(broadcast)


def test_toxicity_counts_and_probabilities(spark):
    """Continuation counts, discounts and the shared back-off by definition; a class' probabilities sum to 1."""
    texts = [("a b a b c", 1), ("a b d b b", 1), ("c b a e a b", 0), ("e e a b c b", 0), ("", 0), (None, 1)]
    counts = toxicity.counted(spark.createDataFrame([(y, t) for t, y in texts], "toxic bigint, text string"))
    words = [(("" if i == 0 else t.split()[i - 1]), w, y) for t, y in texts for i, w in enumerate((t or "").split())]
    seen = Counter((v, w, y) for v, w, y in words)
    pairs = {(v, w) for v, w, _ in words}
    assert sorted((r.toxic, r.ordinary) for r in counts.collect()) == sorted((seen[v, w, 1], seen[v, w, 0]) for v, w in pairs)
    low = toxicity.lower_order(counts)
    follows = lambda w, *ys: len({v for v, x, y in seen if x == w and y in ys})
    assert sorted((r.toxic, r.ordinary, r.shared) for r in low.collect()) == sorted((follows(w, 1), follows(w, 0), follows(w, 0, 1)) for w in {w for _, w in pairs})
    p = toxicity.of_words(low).collect()
    total = {y: sum(follows(w, y) for w in {w for _, w in pairs}) for y in (0, 1)}
    left = {y: sum(max(follows(w, y) - toxicity.DISCOUNT, 0) for w in {w for _, w in pairs}) for y in (0, 1)}
    weight = 1 - min(left[y] / total[y] for y in (0, 1))
    unseen = weight * toxicity.ADDED / (len(pairs) + toxicity.ADDED * (len(p) + 1))
    assert sum(r.p_toxic for r in p) + unseen == pytest.approx(1) and sum(r.p_ordinary for r in p) + unseen == pytest.approx(1)


def test_toxicity_query(spark, docs):
    rows = toxicity.op7_toxicity(spark, docs).collect()
    assert len(rows) == len(documents()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


# 9 -----------------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    vectors = [*base, *base[:10], *(base[10:30] + 0.02 * rng.standard_normal((20, 16))), *(base[30] + 0.05 * rng.standard_normal((40, 16))), *(3 * base[5:8])]
    rows = [(i, [float(np.float32(x)) for x in v], int(i % 2 == 0 and i < 60) if i < 60 else 1) for i, v in enumerate(vectors)]
    rows += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] * 16, 1), (504, rows[0][1], None), (505, [1.0], 1), (506, [2.0], 1), (507, [], 1), (508, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(clashing(df.withColumnRenamed("label", "y")).drop("label").withColumnRenamed("y", "label")).collect()}
    good = [(i, np.array(v, dtype=float), y) for i, v, y in rows if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _, _ in rows}
    for i, v, y in good:
        for j, w, z in good:
            if i != j and y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i].add(j)
    for i, near in links.items():
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(near), min(seen), min(seen) == i), i


def test_collision_count_keeps_recall():
    from math import erf, sqrt

    need, p = embeddings.needed_collisions(), erf(embeddings.WINDOW / sqrt(2))
    import numpy as np

    draws = np.random.default_rng(0).binomial(embeddings.PROJECTIONS, p, 200_000)
    assert (draws >= need).mean() > 0.9999 and need > embeddings.PROJECTIONS / 2


# 10 ----------------------------------------------------------------------------------------------------------------


def shingle_sets(rows):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for d, t, *_ in rows:
        w = SPACE.findall((t or "").translate(fold))
        out.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def test_minhash(spark, docs):
    rows = shingle_sets(documents())
    links = {i: {j for j, (_, b) in enumerate(rows) if i != j and a and b and 100 * len(a & b) >= 75 * len(a | b)} for i, (_, a) in enumerate(rows)}
    want = Counter()
    for i, (d, a) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        want[(d, len(a), min(ids) if ids else None)] += 1
    got = minhash.components(clashing(spark.read.parquet(f"{docs}/documents.parquet"))).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = minhash.keep_first(spark.read.parquet(f"{docs}/documents.parquet").where("doc_id is not null"))
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept and r.doc_id is not None}


def test_small_nodes_and_grid(spark, docs, monkeypatch):
    """With tiny limits every branch and every cell of the grid is used; the result stays."""
    df = spark.read.parquet(f"{docs}/documents.parquet")
    want = Counter((r.doc_id, r.component_id) for r in minhash.components(df).collect())
    monkeypatch.setattr(minhash, "NODE", 3)
    monkeypatch.setattr(minhash, "CHUNK", 2)
    monkeypatch.setattr(minhash, "DEPTH", 3)
    assert Counter((r.doc_id, r.component_id) for r in minhash.components(df).collect()) == want


def test_minhash_recall_with_branching(spark):
    """Pairs at the least similarity inside nodes that branch: a passage that all texts share makes every node large."""
    import random

    rng = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(110))
    rows, pairs = [], []
    for i in range(400):  # four or so words differ; other texts share a passage only
        own = [f"o{i}x{j}" for j in range(40)]
        near = [f"n{i}x{j}" if j in (5 + rng.randrange(3), 14, 22, 30) else w for j, w in enumerate(own)]
        rows += [(2 * i, f"{shared} {' '.join(own)}"), (2 * i + 1, f"{shared} {' '.join(near)}")]
    sets = dict(shingle_sets([(d, t) for d, t in rows]))
    pairs = [(2 * i, 2 * i + 1) for i in range(400)]
    pairs = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(pairs) > 100 and all(100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b]) for a, b in pairs)
    other = 100 * len(sets[0] & sets[2]) / len(sets[0] | sets[2])
    assert other < 75
    calls, branched = [], minhash.branched
    minhash.branched = lambda *a: calls.append(1) or branched(*a)
    try:
        got = {r.doc_id: r.component_id for r in minhash.components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    finally:
        minhash.branched = branched
    assert calls and sum(got[a] == got[b] for a, b in pairs) / len(pairs) > 0.95
    linked = {frozenset(p) for p in pairs}
    assert all(got[d] == d or frozenset((got[d], d)) in linked for d in got)


def test_queries_against_brute_force(spark, docs, tmp_path):
    """The query functions of operators 4, 5, 8, 9 and 10 return what their operators' oracles give, on whole rows."""
    import hashlib

    import tiktoken

    rows = documents()
    gone = line_oracle([(r[0], r[1]) for r in rows])
    for r in line_dedup.op4_line_dedup(spark, docs).collect():
        if r.doc_id is not None:
            text = rows[r.doc_id][1]
            want = sorted(gone.get((r.doc_id, text), ()))
            assert (r.deleted, r.n_deleted, r.n_lines) == (want, len(want), len([x for x in (text or "").split("\n") if x.encode().split()]))
            assert r.text_sha256 == hashlib.sha256(line_dedup.cleaned(text or "", want)[0].encode() if want else (text or "").encode()).hexdigest()
    null = [r for r in line_dedup.op4_line_dedup(spark, docs).collect() if r.doc_id is None]
    assert sorted(r.n_deleted for r in null) == sorted(len(gone.get((None, t), ())) for d, t, *_ in rows if d is None)

    import public_tokenizers as public
    from tiktoken.load import load_tiktoken_bpe

    model = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=load_tiktoken_bpe(public.path("byte_bpe_50k.tiktoken")), special_tokens={})
    lengths, want = Counter(), Counter()
    for d, t, _, source, _ in rows:
        ids = model.encode_ordinary(t or "")
        lengths[False, source, len(ids)] += 1
        lengths[True, None, len(ids)] += 1
        want[d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op5_byte_bpe(spark, docs).collect()) == want
    histogram = byte_bpe.op8_token_counts(spark, docs).collect()
    assert {(r.whole, r.scope, r.length): r.n_docs for r in histogram} == dict(lengths)
    for r in histogram:
        mine = [(n, k) for (whole, scope, n), k in lengths.items() if (whole, scope) == (r.whole, r.scope)]
        assert r.n_above == sum(k for n, k in mine if n > r.length) and r.n_up_to == sum(k for n, k in mine if n <= r.length)
        assert r.total_tokens == sum(n * k for n, k in mine) and r.truncated_tokens == sum(min(n, r.length) * k for n, k in mine)

    sets = shingle_sets(rows)
    got = minhash.op10_minhash(spark, docs).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((d, len(s)) for d, s in sets) and all(r.kept == (r.doc_id == r.component_id) for r in got)

    vectors = [(i, [float(i % 7 == j) + 0.01 * (i % 3) for j in range(8)], i % 2) for i in range(60)] + [(60, None, 1), (61, [0.0] * 8, 1), (61, [1.0] * 8, None)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    import numpy as np

    stored = [(i, None if v is None else np.array(v, dtype=np.float32).astype(float), y) for i, v, y in vectors]
    cos = lambda v, w: v @ w / np.linalg.norm(v) / np.linalg.norm(w)
    for r in embeddings.op9_embeddings(spark, str(tmp_path)).collect():
        if r.vec_id < 60:
            _, v, y = stored[r.vec_id]
            assert r.n_links == sum(1 for j, w, z in stored if j != r.vec_id and z == y and w is not None and w.any() and cos(v, w) >= 0.98)
        else:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)


# pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline(spark, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    before = pii.op1_pii(spark, docs)
    out = pipeline.run(spark, docs)
    assert before.count() == len(documents())  # the tables that it reads are still there
    assert [n for n, _ in pipeline.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "source_mixing", "byte_bpe"]
    assert out.count() > 20 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    common.release_all()


def test_pipeline_against_brute_force(spark, docs):
    """Each stage's rows from the rows of the one before, by the definitions that the operators' own tests hold."""
    pipeline = pytest.importorskip("corpus_pipeline")
    df, path = spark.read.parquet(f"{docs}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"]), None
    rows = {}
    for name, work in pipeline.STAGES:
        out = work(spark, df, docs)
        path = f"{docs}/after-{name}"
        out.write.mode("overwrite").parquet(path)
        rows[name], df = df.collect(), spark.read.parquet(path)
    last = df.collect()
    good = rows["line_dedup"]
    base = [r for r in rows["quality_rules"] if (c := counts(r.text))[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    assert {r.doc_id for r in good} <= {r.doc_id for r in base} and len(good) > 0.8 * len(base)
    gone = line_oracle([(r.doc_id, r.text) for r in good])
    want = {}
    for r in good:
        text, n = line_dedup.cleaned(r.text, sorted(gone.get((r.doc_id, r.text), ())))
        if len(gone.get((r.doc_id, r.text), ())) < n:
            want[r.doc_id] = text
    assert {r.doc_id: r.text for r in rows["minhash_dedup"]} == want
    sets = shingle_sets([(d, t) for d, t in want.items()])
    links = {d: {e for e, b in sets if d != e and a and b and 100 * len(a & b) >= 75 * len(a | b)} for d, a in sets}
    kept = set()
    for d in links:
        seen, todo = {d}, [d]
        while todo:
            for e in links[todo.pop()] - seen:
                seen.add(e)
                todo.append(e)
        kept |= {d} if min(seen) == d else set()
    assert {r.doc_id for r in rows["source_mixing"]} == kept
    sizes = {r.doc_id: len(SPACE.findall(r.text)) for r in rows["source_mixing"]}
    taken = Counter()
    for r in rows["byte_bpe"]:
        taken[r.doc_id] += len(SPACE.findall(r.text))
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 3 and all(taken[d] <= 2 * sizes[d] for d in taken)
    import hashlib

    assert Counter(r.decoded_sha256 for r in last) == Counter(hashlib.sha256(r.text.encode()).hexdigest() for r in rows["byte_bpe"])


def test_stages_return_document_columns_and_take_empty_tables(spark, empty):
    pipeline = pytest.importorskip("corpus_pipeline")
    df = spark.read.parquet(f"{empty}/documents.parquet")
    for name, stage in pipeline.STAGES:
        out = stage(spark, df, empty)
        assert out.count() == 0
        assert name == "byte_bpe" or out.columns == df.columns

import hashlib
import math
import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brook.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [",".join(f"{P.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)), *(sum(k == n for _, k, _ in found) for n in range(4))]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").where("t is not null")
    rows = P.base_spans(df).select("id", P._written(P.F.col("e")).alias("s")).collect()
    return {r.id: r.s for r in rows}


EDGES = [
    "", "a@b", "a@b.c", "é.x_y%z+1-2@mail.example.co.uk, z", "a@b.c%d@e.f", "a@b.c.@d.e", "a@@b.c x@y.z@w.v", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 255.0.00.0255", "1.2.3.4.5",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111 1111 1111", "5 4111111111111111", "41111111111111111111111", "+1 (743) 555-3824", "+1 (743) 555-3824 4379362835490466", "+12345678", "+1 2 3 4 5 6 7 8 9.", "+1+2 345-678-9012", "😀 a@b.c 😀 1.2.3.4",
    "4785380592391139$$$ é 152.143.123.131### ", "0000000000000000", "12 345-678 90-12--3456 7890 1234 5678", "+١٢٣ 1.2.3",
]


def test_base_edges(spark):
    texts = [*EDGES, "a" * 100_000 + "@", "1" * 100_000, "1." * 30_000, "a.b" * 20_000 + "@c.d" * 20_000, "7 " * 40_000 + "x a@b.cd"]
    got = found(spark, texts)
    assert [got[i] for i in range(len(texts))] == [brute(t)[0] for t in texts]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="1a@.+ -(%é", max_size=50) | st.text(alphabet="0123456789 -", max_size=40), min_size=20, max_size=60))
def test_base_random(spark, texts):
    got = found(spark, texts)
    assert [got[i] for i in range(len(texts))] == [brute(t)[0] for t in texts]


def terms_of(text, spans):
    for start, end in sorted(spans, reverse=True):
        text = text[:start] + "\n" + text[end:]
    return {w for w in re.findall(r"[^\W\d_](?:[^\W\d_]|['-])*", text.lower()) if len(w) >= 3}


def classes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    group = [value.lower().split("@")[-1], ".".join(value.split(".")[:2]), digits[:6], digits[:4]][kind]
    return ("entity", kind, digits if kind >= 2 else value.lower()), ("group", kind, group), ("kind", kind), ("any",)


def spans_of(text):
    out = []
    for x in filter(None, brute(text)[0].split(",")):
        kind, start, end = x.split(":")
        out.append((P.KINDS.index(kind), int(start), int(end)))
    return out


def told_by(texts, homes, support, chance, generalise, remove):
    """Disclosing terms, plainly: {term: (share, removed)}.  homes: the one text in which a wider class counts an entity."""
    n = len(texts)
    by_class = {}
    for t in texts:
        for k, s, e in spans_of(t):
            for c in classes(k, t[s:e]):
                by_class.setdefault(c, {}).setdefault(t, set()).add(classes(k, t[s:e])[0])
    out = {}
    for c, held in by_class.items():
        unit = lambda t: 1 if c[0] == "entity" else sum(homes[x] == t for x in held[t])  # noqa: B023, E731
        n_class, n_units = sum(t in held for t in texts), sum(map(unit, held))
        for w in set().union(*(terms_of(t, [x[1:] for x in spans_of(t)]) for t in held)):
            mine = [t for t in held if w in terms_of(t, [x[1:] for x in spans_of(t)])]
            together, units = sum(t in mine for t in texts), sum(map(unit, mine))
            n_term = sum(w in terms_of(t, []) for t in texts)
            expected = n_units * n_term / n
            if n_units < support or units < support or units <= expected:
                continue
            ratio = units * math.log(units / expected) + ((n_units - units) * math.log((n_units - units) / (n_units - expected)) if units < n_units else 0)
            share = math.log2(together * n / (n_term * n_class)) / max(math.log2(n / n_class), 1e-9)
            if ratio >= -math.log(chance) and share >= generalise:
                out[w] = max(out.get(w, 0), round(share, 9))
    return {w: (x, x >= remove) for w, x in out.items()}


def corpus():
    other = [f"plain words about nothing number{i} here today" for i in range(40)]
    told = [f"write to Ann Quimby via quimby@mail.example.com or {i} words{i}" for i in range(4)]
    return [(i, t) for i, t in enumerate(other + told)] + [(90, None), (91, ""), (None, told[0]), (92, told[0]), (93, "Quimby alone, and here"), (94, "plain words nothing")]


LOOSE = {"chance": 0.01}


def test_terms_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("alpha", "beta", "gam", "del") for b in ("x", "y'z", "q-r", "é")]
    texts = []
    for i in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 7))]
        if i % 4 == 0:
            words += ["signed", rng.choice(["mail", "dial"]), rng.choice([f"u{i % 9}@h{i % 3}.example.com", f"10.{i % 2}.3.{i}", "4111 1111 1111 1111", f"+1 (243) 555-{i:04d}"])]
        texts.append(" ".join(words))
    texts += texts[:12] + texts[:1] * 9
    docs = P._keyed(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", "t")
    hashes = {r.t: (r.a, r.b) for r in docs.collect()}
    homes = {}
    for t in set(texts):
        for k, s, e in spans_of(t):
            x = classes(k, t[s:e])[0]
            homes[x] = min(homes.get(x, t), t, key=hashes.get)
    names = {r.h: r.w for r in spark.createDataFrame([(w,) for w in set().union(*(terms_of(t, []) for t in texts))], "w string").select("w", P.F.xxhash64("w").alias("h")).collect()}
    found = P._found(docs)
    for options in ((3, 1e-9, 0.8, 0.97), (2, 0.01, 0.3, 0.6), (3, 0.5, 0.05, 0.5)):
        got = {names[r.term]: (round(r.share, 9), r.removed) for r in P.disclosing_terms(found, docs, *options).collect()}
        assert got == told_by(texts, homes, *options)
        assert "signed" in got or options[2] > 0.5


def test_terms(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, a long")
    got = P.find_spans(df, **LOOSE).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    text = dict(rows)[40]
    want = text.index("Quimby")
    assert f"term:{want}:{want + 6}" in by[40].spans.split(",") and "email" in by[40].spans
    assert by[92].spans == by[40].spans == by[None].spans
    assert by[93].spans == "term:0:6" and by[94].spans == by[90].spans == by[0].spans == ""
    for r in got:
        base, *counts = brute(dict(rows)[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))
    assert P.find_spans(df.limit(0)).collect() == []
    assert sum(r.n_term for r in P.find_spans(df, chance=1e-30).collect()) == 0


def test_sanitise(spark):
    rows = corpus() + [(95, "call +1 (743) 555-3824, now"), (96, "x 4111 1111 1111 1111 y"), (97, "the quimby again")]
    helpers = ["row", "t", "a", "b", "e", "p", "bucket", "marked", "all", "gone", "removed", "_ka", "_a", "spans"]
    df = spark.createDataFrame([(i, t, *range(len(helpers))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{h} long" for h in helpers))
    for options in (LOOSE, {"chance": 1e-30}):
        out = P.sanitise(df, **options)
        assert out.columns == df.columns and out.count() == len(rows)
        done = out.collect()
        assert all(tuple(r)[2:] == tuple(range(len(helpers))) for r in done)
        got = {r.doc_id: r.text for r in done}
        assert got[90] is None and got[91] == "" and got[0] == rows[0][1]
        assert got[96] == "x <CARD> y" and "<PHONE>" in got[95] and got[95].startswith("call ") and got[95].endswith(", now")
        assert "<EMAIL>" in got[40] and ("Quimby" in got[40]) == (options is not LOOSE)
    assert {r.doc_id: r.text for r in P.sanitise(df, generalise=0.7, remove=2.0, chance=0.01).collect()}[93].startswith("<NAME> alone")
    assert {r.doc_id: r.text for r in P.sanitise(df, generalise=0.7, remove=2.0, chance=0.01).collect()}[97] == "the <WORD> again"
    assert {r.doc_id: r.text for r in P.sanitise(df, remove=0.8, chance=0.01).collect()}[93] == " alone, and here"

"""Every operator against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from roadflow.llm import decontaminate, embeddings, lines, lm, packing, pii, queries, simhash, suffixes, tokens, toxicity, urls
from roadflow.llm.common import connected_components

DOC = "doc_id long, text string, lang string, source string, n_chars long, fp string, component string, tag string, h string, spans string"
WORDS = "the of and heron stone quartz lyre ember sable tundra moss fjord kelp onyx pine".split()


def corpus(seed=0, n=40):
    rng = random.Random(seed)
    texts = ["\n".join(" ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.randint(8, 40))) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    texts[5] = texts[2]
    texts[9] = texts[3][:60] + "X" + texts[3][61:]
    texts[11] = texts[4] + "\n" + texts[6]
    texts[12] = texts[7][:-1]
    return [None, "", " \n\t", "a", "é" * 40, " ".join(WORDS * 800), *texts]


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "src0", len(t or ""), "x", "x", "x", "x", "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOC)


def union_find(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


# -- connected components


def test_components(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(30)] + [(50, k) for k in range(60, 90)] + [(rng.randint(100, 140), rng.randint(100, 140)) for _ in range(20)] + [(7, 7)]
    want = union_find(150, pairs)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: want[x] for a, b in pairs if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# -- 1 URL filters


def test_url_rules_and_parts(spark):
    cases = [
        (None, "", "", None, "allow"),
        ("nothing", "", "", None, "allow"),
        ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://example.net/fr/1", "example.net", "/fr/1", "net/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("x://b.example.com/de/7#q://z", "b.example.com", "/de/7", "example.com/de/", "block"),
        ("http://net", "net", "", None, "allow"),
        ("http://h.org/fr/", "h.org", "/fr/", "org/fr/", "allow"),
        ("http://É.org", "É.org", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, c[0], "x", "x") for k, c in enumerate(cases)], "page_id long, url string, host string, tokens string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, none, queries.URL_RULES).collect()}
    assert got == {k: c[1:] for k, c in enumerate(cases)}
    assert urls.judge(pages.limit(0), none, queries.URL_RULES).count() == 0


def test_url_mining_is_brute_force(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(300):
        spam = rng.random() < 0.3
        rows.append((k, f"http://{rng.choice(['www', 'm'])}.{rng.choice(['pills', 'poker']) if spam else rng.choice(['news', 'pills', 'wiki'])}.example/{rng.choice(['a', 'b'])}/{k}"))
        if k % 3:
            labels.append((k, 0 if spam else 1))
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string")
    got = urls.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int"), min_support=0.02, min_confidence=0.6).collect()

    def toks(u):
        host, _, path = u.split("://")[1].partition("/")
        return {"h:" + x for x in host.split(".")} | {"p:" + ("0" if x.isdigit() else x) for x in path.split("/") if x}

    good = dict(labels)
    known = [(toks(u), good[k] == 0) for k, u in [*rows, rows[0]] if k in good]
    least = math.ceil(max(0.02, urls.MIN_ROWS / len(known)) * len(known))
    every, bad = Counter(), Counter()
    for t, b in known:
        for n in (1, 2, 3):
            for c in itertools.combinations(sorted(t), n):
                every[c] += 1
                bad[c] += b
    rules = [set(c) for c in every if bad[c] >= least and bad[c] / every[c] >= 0.6]
    assert rules and {(r.page_id, r.verdict) for r in got} == {(k, "block" if any(x <= toks(u) for x in rules) else "allow") for k, u in rows}
    assert len(got) == 301


def test_url_rules_of_any_length(spark):
    # bad only where four (five) tokens meet: any three (four) of them are mostly good
    rows, labels = [], []
    for parts in (("m", "shop", "a", "b"), ("w", "club", "c", "d", "e")):
        for on in itertools.product((0, 1), repeat=len(parts)):
            for _ in range(12):
                t = [x if o else x + "x" for x, o in zip(parts, on, strict=True)]
                rows.append((len(rows), f"http://{t[0]}.{t[1]}.example/" + "/".join(t[2:])))
                labels.append((len(labels), 0 if all(on) else 1))
    pages, lab = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.page_id: r.verdict for r in urls.judge(pages, lab, min_confidence=0.6).collect()}

    def toks(u):
        return frozenset(re.findall(r"\w+", u.split("://")[1]))

    good, sets = dict(labels), {}
    every, bad = Counter(), Counter()
    for k, u in rows:
        t = toks(u)
        for c in sets.setdefault(t, [c for n in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), n)]):
            every[c] += 1
            bad[c] += good[k] == 0
    rules = [set(c) for c in every if bad[c] >= urls.MIN_ROWS and bad[c] / every[c] >= 0.6]
    assert rules and min(map(len, rules)) == 4
    assert got == {k: "block" if any(x <= toks(u) for x in rules) else "allow" for k, u in rows}
    assert {k for k, v in got.items() if v == "block"} == {k for k, q in labels if q == 0}


def test_url_lift_rules_are_the_sql_twins(spark, tmp_path):
    from roadflow.llm import sql

    rng = random.Random(2)
    rows, labels = [], []
    for k in range(900):
        shop = rng.random() < 0.2
        rows.append((k, f"http://{rng.choice(['www', 'm'])}.{'pills' if shop else rng.choice(['news', 'wiki', 'blog'])}.example/{rng.choice(['a', 'b'])}/{k}"))
        if k % 4:
            labels.append((k, 0 if rng.random() < (0.45 if shop else 0.12) else 1, 0))
    pages, lab = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted((r.page_id, r.verdict, r.confidence) for r in urls.judge(pages, lab, queries.URL_RULES).collect())
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    con.register("labels", lab.toPandas())
    want = sorted((r[0], r[4], r[5]) for r in con.sql(sql.oracle_sql()["op1_url_filters"]).fetchall())
    assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])
    assert {k for k, v, _ in got if v == "block"} >= {k for k, u in rows if "pills" in u} and len({v for _, v, _ in got}) == 2


# -- 2 decontamination


def test_reparameterised_questions(spark):
    item = "If Maria walks 12 km in 3 hours and Maria then rests 12 minutes what is her mean speed over the whole way home"
    docs = [
        "Some words here. " + item + ". More words there",
        "Intro text. If Peter walks 40 km in 5 hours and Peter then rests 40 minutes what is her mean speed over the whole way home",
        "Intro text. If Peter walks 40 km in 5 hours and Paul then rests 7 minutes what is her mean speed over the whole way home",
        "quite another text about nothing in particular with 12 km in 3 hours",
        None,
        "",
        " ".join(WORDS * 3000),
    ]
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, item, "x")], "item_id long, text string, doc_id string")
    d = frame(spark, docs + docs[:1], [*range(len(docs)), 0])
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.contaminated(d, bench).collect()}
    assert got == {(0, 1): True, (0, 4): True, (1, 1): False, (1, 4): False}
    assert {r.doc_id for r in decontaminate.remove(d, bench).collect()} == {2, 3, 4, 5, 6}
    assert decontaminate.contaminated(d, bench.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), bench).count() == 0
    assert decontaminate.remove(d, bench).columns == d.columns


def test_signs_short_items_and_codes(spark):
    money = "the shop sells the red lamp for $9 and the blue lamp for 12 dollars to every guest"
    bench = spark.createDataFrame([(1, money), (2, "capital of France"), (3, "Paris"), (4, "5 apples"), (5, "if you add 3 km and 4 km")], "item_id long, text string")
    docs = [
        "Intro. " + money.replace("$9", "9 dollars").replace("12 dollars", "$12") + ". End",
        "Intro. " + money.replace("$9", "$30").replace("12 dollars", "7 dollars") + ". End",
        "What is the capital of France please",
        "What is the capital of Spain please",
        "Paris",
        "we saw Paris and 5 apples",
        "$5$6$7 5 % km $ 8 km",
        "so if you add 8 km and 9 km",
    ]
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert got == {(0, 1): True, (1, 1): False, (2, 2): True, (4, 3): True, (7, 5): False}
    rng = random.Random(0)
    some = ["$", "€", "%", "5", "6.5", "km", "Miles", "feet", "Bob", "the", "USA", "a", ".", "\n", "°", "Anna"]
    for t in docs + [" ".join(rng.choice(some) for _ in range(rng.randint(0, 9))) for _ in range(5000)]:
        toks, _, heads = decontaminate.template(t)
        codes, at = decontaminate.template_codes(t, {})
        assert [decontaminate._code(x) for x in toks] == codes.tolist() and heads == at.tolist(), t


def test_codes_come_without_token_lists(monkeypatch):
    rng = random.Random(7)
    some = ["$", "€", "%", "5", "6.5", "1,2.", "km", "Km", "Miles", "Bob", "USA", "O'Neil", "d’", "a", "Anna", ".", "\n", "½", "²", "x²", "²a", "Ⅷ", "ΟΔΟΣ", "οδος", "İzmir", "Aǅ", "𝐀𝐛", "中文", "١٢", "_", "Ab" * 40, "b" * 65]
    texts = ["".join(rng.choice(some) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    texts += ["5$6$7 $5$6$7$ 8 km", "½ km and 5 ½ km", None, "", " ".join(rng.choice(some) for _ in range(3000))]
    want = [decontaminate.template(t) for t in texts]
    monkeypatch.setattr(decontaminate, "_TOKEN", None)  # a list of all tokens is what took the time
    for piece in (150_000, 50):
        monkeypatch.setattr(decontaminate, "_PIECE", piece)
        codes, heads, first = decontaminate._together(texts, {})
        for (toks, _, at), a, b in zip(want, first[:-1].tolist(), first[1:].tolist(), strict=True):
            assert [decontaminate._code(x) for x in toks] == codes[a:b].tolist() and at == np.flatnonzero(heads[a:b]).tolist(), toks


def test_decontamination_is_brute_force(spark):
    rng = random.Random(4)
    few, names = WORDS[:6], ["Ada", "Bea", "Cid"]

    def sentence(n):
        return " ".join(rng.choice([*few, rng.choice(names), str(rng.randint(1, 3)), "km"]) for _ in range(n))

    items = [sentence(rng.randint(3, 12)) for _ in range(12)]
    docs = [sentence(rng.randint(0, 40)) for _ in range(40)] + [sentence(6) + ". " + rng.choice(items) + ". " + sentence(8) for _ in range(12)]
    want = {}
    for (i, item), (d, doc) in itertools.product(enumerate(items), enumerate(docs)):
        sides = []
        for text in (item, doc):
            toks, vals, heads = decontaminate.template(text)
            w = min(5, len(decontaminate.template(item)[0]))
            rows = []
            for kind in (0, 1):
                t = ["<name>" if kind and k in heads else x for k, x in enumerate(toks)]
                v = [toks[k] if kind and k in heads else x for k, x in enumerate(vals)]
                rows += [(tuple(t[k : k + w]), tuple(toks[k : k + w]), k, "\x1f".join(x for x in v[k : k + w] if x is not None), kind) for k in range(len(toks) - w + 1) if not kind or t[k : k + w] != toks[k : k + w]]
            sides.append((rows, len(toks)))
        (a, n), (b, m) = sides
        keys = sorted({x[1] for x in a})
        met = {(keys.index(x[1]), x[2], y[2], max(x[4], y[4]), x[3], y[3]) for x in a for y in b if x[0] == y[0]}
        if not keys or len({x[0] for x in met}) < 0.5 * len(keys):
            continue
        v = decontaminate._judge(sorted(met), 0.5 * len(keys), len({x[2] for x in a}))
        if v and (v == 2 or n >= 5) and (n >= 3 or n == m):
            want[d, i] = (len(keys), len({x[0] for x in met}), v == 2)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_windows, r.n_matched, r.verbatim) for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert len(want) > 10 and got == want


def test_every_alignment_is_tried(spark):
    same = "the farmer counts 3 apples in the basket and then the farmer counts 5 apples in the basket before going home to rest"
    late = "we find that Maria walks 12 km in 3 hours and later on Maria also rests 12 minutes at home before she leaves"
    names = "Alice has 3 apples. Bob has 5 apples. Carol has 7 apples. How many apples have Alice and Bob and Carol"
    bench = spark.createDataFrame([(1, same), (2, late), (3, names)], "item_id long, text string")
    docs = [
        "Intro. " + same.replace("3", "7").replace("5", "9") + ". End",
        "it is known that Peter walks 40 km in 8 hours. " + " ".join(WORDS * 20) + ". we find that Paula walks 9 km in 4 hours and later on Paula also rests 9 minutes at home before she leaves",
        "Intro. " + names.replace("Alice", "Dora").replace("Bob", "Emil").replace("Carol", "Fritz").replace("5", "6") + ". End",
        "Intro. " + late.replace("Maria also", "Paula also") + ". End",
        "intro. " + names + ". End",
    ]
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.contaminated(frame(spark, docs), bench).collect()}
    assert got == {(0, 1): False, (1, 2): False, (2, 3): False, (4, 3): True}


# -- 3 PII


def naive_pii(t):
    t = t or ""

    def digits(s):
        return re.sub(r"[^0-9]", "", s)

    def luhn(s):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(s[::-1])) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_detectors():
    rng = random.Random(2)
    fixed = ["a@b.c@d.e", "x@@y.z", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4", "4111 1111-1111 1111", "+1 (555) 123-4567", "++1 5551234567-", "é@b.cc", "a.@b-.c-", "4111111111111111 4111"]
    for t in fixed + ["".join(rng.choice("aB1234567890.@+-() ") for _ in range(rng.randint(0, 60))) for _ in range(3000)]:
        assert pii.base_spans(t) == naive_pii(t), t


def test_bootstrap_finds_unseen_identifiers(spark):
    texts = [f"please write to user{k}@mail.example.com today friend" for k in range(20)] + ["please write to hidden77(at)mail today friend", "the number 123456 stands alone", None, ""]
    rows = pii.find(frame(spark, texts + texts[:1], [*range(len(texts)), 0])).collect()
    added = {r.doc_id: [(s.kind, s.start, s.end) for s in r.added] for r in rows if r.added}
    assert len(rows) == len(texts) + 1
    assert added == {20: [("email", 16, 32)]} or added == {20: [("email", 16, 31)]}
    assert pii.find(frame(spark, [])).count() == 0


def test_patterns_learn_secrets(spark):
    hexes = [hashlib.sha1(str(k).encode()).hexdigest() for k in range(12)]
    texts = [f'set token = "{h}" now' for h in hexes] + [f"login password={h[:20]} ok" for h in hexes]
    texts += ['set token = "Tr0ub4dor&3x" now', "login password=hunter2secret9 ok", "the code hunter2secret9 stands elsewhere", "no secret 1234567 here"]
    texts += ["x" * 50 + f"{k} 77777{k} tail" for k in range(6)]
    got = {r.doc_id: {t[s.start : s.end] for s in r.added if s.kind == "secret"} for t, r in zip(texts, sorted(pii.find(frame(spark, texts)).collect(), key=lambda r: r.doc_id), strict=True)}
    assert all(got[k] == {h} for k, h in enumerate(hexes)) and all(got[12 + k] == {h[:20]} for k, h in enumerate(hexes))
    assert got[24] == {"Tr0ub4dor&3x"} and got[25] == {"hunter2secret9"} and not any(got[k] for k in range(26, len(texts)))


# -- 4 SimHash


def naive_fp(t, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
    s = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if s and 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_is_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: (simhash_hex, r.component_id) for r in simhash.near_duplicates(frame(spark, texts)).withColumn("hex", simhash.hex16(F.col("fp"))).collect() for simhash_hex in [r.hex]}
    fps = [naive_fp(t) for t in texts]
    comp = union_find(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert got == {k: (f"{fps[k]:016x}", comp[k]) for k in range(len(texts))}


def test_simhash_links_are_all_pairs_within_two_bits(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:25]:
        for _ in range(4):
            f ^= 1 << rng.randrange(64) | (1 << rng.randrange(64) if rng.random() < 0.7 else 0)
            fps.add(f)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    pairs = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 2]
    want = union_find(len(fps), pairs)
    at = {f: k for k, f in enumerate(fps)}
    found = [(at[r.u], at[r.v]) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()]
    assert union_find(len(fps), found) == want and {tuple(sorted(p)) for p in found} <= set(pairs)


def test_simhash_edges(spark):
    d = frame(spark, ["a b c", "a b c", "x y z w"], [4, 4, None])
    assert simhash.near_duplicates(d).count() == 3 and simhash.near_duplicates(d.limit(0)).count() == 0
    kept = simhash.keep_one_each(frame(spark, ["a b c", "A  b c", "other words here", None, ""], [7, 3, 5, 8, 9])).collect()
    assert sorted(r.doc_id for r in kept) == [3, 5, 8]


def test_near_copies_are_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "one two", "One TWO", "a b c d e f g h", "a b c d e f g h i"]
    for size in (12, 40, 150, 600):
        for _ in range(4):
            base = [rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(size)]
            texts.append(" ".join(base))
            for edits in (1, 1, 2, 4, 8):
                new = list(base)
                for at in rng.sample(range(size), edits):
                    new[at] = f"edit{rng.randint(0, 9999)}"
                texts.append(" ".join(new[: size - edits // 2]))
    rng.shuffle(texts)

    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = [cut(t) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = union_find(len(texts), pairs)
    assert len(pairs) > 30
    got = simhash.near_copies(frame(spark, texts))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(want))
    assert {r.doc_id for r in simhash.keep_one_each(frame(spark, texts)).collect()} == set(want)
    assert simhash.keep_one_each(frame(spark, [])).count() == 0


def test_stage_goes_through_the_fingerprints(spark, monkeypatch):
    """The near-copy stage links by the byte-position index first, and its exact search adds the pairs that two bits miss."""
    rng = random.Random(3)
    base = [rng.choice(WORDS) + str(rng.randint(0, 4000)) for _ in range(900)]
    texts = [" ".join(base), " ".join([*base, "end"]), " ".join([f"new{k}" if k % 100 == 50 else w for k, w in enumerate(base)]), "other words of a text that is alone"]
    seen, index = [], simhash.links

    def spy(fps):
        seen.append(index(fps).count())
        return index(fps)

    monkeypatch.setattr(simhash, "links", spy)
    assert [r.component_id for r in simhash.near_copies(frame(spark, texts)).orderBy("doc_id").collect()] == [0, 0, 0, 3]
    assert seen
    monkeypatch.setattr(simhash, "_led", lambda rows, k, similarity: rows.select(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v")).limit(0))
    monkeypatch.setattr(simhash, "_all_plausible", lambda rows, similarity: rows.select(F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v")).limit(0))
    assert [r.component_id for r in simhash.near_copies(frame(spark, texts)).orderBy("doc_id").collect()][:2] == [0, 0]


def test_near_copies_in_hot_posts(spark, monkeypatch):
    """Posts of many blocks and groups that one leader does not connect: all that brute force connects."""
    monkeypatch.setattr(simhash, "BLOCK", 4)
    monkeypatch.setattr(simhash, "LEADERS", 1)
    rng = random.Random(12)
    shared = " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(60)).split()
    texts = []
    for g in range(6):
        own = shared[:50] + [f"g{g}x{k}" for k in range(30)]
        texts += [" ".join([*own[:-1], f"e{g}y{k}"]) for k in range(6)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = union_find(len(texts), [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in simhash.near_copies(frame(spark, texts)).collect()} == dict(enumerate(want)) and len(set(want)) == 6


# -- 5 repeated strings


def naive_cut(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot, few", [(50_000, 8_000_000), (3, 8_000_000), (50_000, 0)])
def test_repeats_are_brute_force(spark, monkeypatch, hot, few):
    monkeypatch.setattr(suffixes, "PIECE", 70)
    texts = corpus(4, 25) + ["x" + "ab" * 900 + "y", "ab" * 400, "ab" * 60, "ba" * 55 + "é" * 30, "z" * 49, "z" * 50, "z" * 120]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    got = suffixes.dedup(frame(spark, [t for _, t in rows], [i for i, _ in rows]), hot, few).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got} == naive_cut(rows)


def test_suffix_order():
    rng = random.Random(0)
    for _ in range(150):
        s = np.array([rng.randint(1, rng.choice([1, 2, 9])) for _ in range(rng.randint(1, 50))])
        assert np.argsort(suffixes.suffix_order(s, 10**6), kind="stable").tolist() == sorted(range(len(s)), key=lambda k: s[k:].tolist())


def test_repeats_edges(spark):
    t = "q" * 30 + "the same long passage in both of the documents here" * 2
    got = {(r.doc_id, r.n_removed) for r in suffixes.dedup(frame(spark, [t, t, t], [None, 5, 5])).collect()}
    assert got == {(None, 0), (5, 0)} and suffixes.dedup(frame(spark, [])).count() == 0


# -- 6 embeddings


def test_embeddings_are_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 8))
    x = [*base, *(base[:20] + rng.normal(scale=0.25, size=(20, 8))), *(base[:3] * 2.5), *np.repeat(base[4:5], 5, axis=0)]
    rows = [(k, [float(c) for c in v], 0) for k, v in enumerate(x)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [float("nan")] * 8, 0), (n + 3, [None] * 8, 0), (n + 4, [], 0), (n + 5, [1.0, 2.0], 0), (n + 6, [float("inf")] + [0.0] * 7, 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep int")).collect()}
    u = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    pairs = [(a, b) for a, b in itertools.combinations(range(n), 2) if u[a] @ u[b] >= 0.9]
    links, comp = Counter(k for p in pairs for k in p), union_find(n, pairs)
    assert got == {k: (links[k], comp[k], comp[k] == k) for k in range(n)} | {k: (0, k, True) for k in range(n, n + 7)}
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_blocks_find_all_links():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 4))
    a /= np.linalg.norm(a, axis=1)[:, None]
    w = rng.integers(1, 4, 300)
    na, nb, spans = embeddings.compare(a[:150], a[150:], w[:150], w[150:], 0.9, False)
    hit = a[:150] @ a[150:].T >= 0.9
    assert (na == hit @ w[150:]).all() and (nb == hit.T @ w[:150]).all()
    every = union_find(300, [(i, 150 + j) for i, j in zip(*np.nonzero(hit), strict=True)])
    assert union_find(300, [(i, 150 + j) for i, j in spans]) == every and all(hit[i, j] for i, j in spans)


def _shuffled(spark):
    """Bytes that the session's stages have written to shuffles so far."""
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_vectors_are_shuffled_once(spark, monkeypatch):
    """Blocks without pruning are compared with each other, but not shipped for each pair of them."""
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    x = np.random.default_rng(3).normal(size=(3000, 64)).astype(np.float32)
    d = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    before = _shuffled(spark)
    assert embeddings.near_duplicates(d).where("n_links = 0 AND kept").count() == 3000
    assert _shuffled(spark) - before < 3 * x.nbytes


def test_repeated_vector_ids_and_parts(spark, monkeypatch):
    """Rows of one id with other vectors have their own links; copies, floats and many parts give what brute force gives."""
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(80, 6)).astype(np.float32)
    x = [*base, *(base[:40] + rng.normal(scale=0.2, size=(40, 6))).astype(np.float32), *np.repeat(base[7:8], 90, axis=0)]
    ids = [*range(100, 100 + len(x) - 2), 100, 101]
    rows = [(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)] + [(None, [1.0] * 6), (7, [-0.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    u = np.array(x, np.float64) / np.linalg.norm(np.array(x, np.float64), axis=1)[:, None]
    hit = u @ u.T >= 0.9
    comp = union_find(len(x), [p for p in zip(*np.nonzero(hit), strict=True) if p[0] != p[1]])
    low = {c: min(ids[k] for k in range(len(x)) if comp[k] == c) for c in comp}
    want = Counter((ids[k], int(hit[k].sum()) - 1, low[comp[k]], ids[k] == low[comp[k]]) for k in range(len(x)))
    assert got == want + Counter([(None, 0, None, False), (7, 0, 7, True)])


# -- 7 packing


def naive_bins(lengths, cap):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [(left, k) for k, left in enumerate(bins) if left >= x]
        if fit:
            bins[min(fit)[1]] -= x
        else:
            bins.append(cap - x)
    return sorted(bins)


def test_plan_is_piecewise_best_fit():
    rng = random.Random(1)
    for _ in range(200):
        cap = rng.choice([5, 16, 50])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 90))]
        left, seen = {}, Counter()
        for x, rank, n, first, offset in packing.plan(Counter(lengths).items(), cap):
            assert seen[x] == rank or n
            seen[x] += n
            for k in range(first, first + n):
                assert left.get(k, cap) == cap - offset
                left[k] = cap - offset - x
        assert seen == Counter(lengths) and sorted(left.values()) == naive_bins(lengths, cap)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = [*corpus(2, 20), "a  b", " lead", "trail ", "x\u00a0y z", "it's <|endoftext|> here", "\x1c a b"]
    hf = Tokenizer.from_file(path)
    got = packing.pack(frame(spark, texts + texts[-1:], [*range(len(texts)), len(texts) - 1]), path, 64).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts[:-1]):
        ids = hf.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = sorted(by[i], key=lambda r: r.piece)
        assert sum(r.length for r in cuts) == len(ids) and [r.piece for r in cuts] == list(range(len(cuts)))
        assert len(cuts) == 1 or all(r.length == 64 for r in cuts[1:])
        for r in cuts:
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    assert len(seqs) == len(naive_bins([r.length for r in got], 64))
    assert packing.pack(frame(spark, []), path).count() == 0


def test_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    hf, own, rng = Tokenizer.from_file(path), tokens.encoder(path), random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice(["a", "B", " ", "  ", "\n", "'s", "1", "é", ".", "\t", "word", " the", "\u2003", "<|"]) for _ in range(rng.randint(0, 25)))
        assert np.frombuffer(own(t), "<u4").tolist() == hf.encode(t, add_special_tokens=False).ids, repr(t)


# -- 8 language model


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_brute_force(spark, order):
    assert lm.ORDER == 3
    texts = corpus(6, 30)
    got = {r.doc_id: r for r in lm.score(frame(spark, texts), order).collect()}
    words = [[w.lower() for w in re.findall(r"\w+", t or "")] for t in texts]

    def grams(d):
        return Counter(tuple(d[k : k + n]) for n in range(1, order + 1) for k in range(len(d) - n + 1))

    every = sum(map(grams, words), Counter())
    n = sum(map(len, words))
    for i, d in enumerate(words):
        own = grams(d)
        rest, total = max(1, n - len(d)), 0.0
        for k, w in enumerate(d):
            c = every[(w,)] - own[(w,)]
            s = c / rest if c else 0.4 / rest
            for m in range(2, min(order, k + 1) + 1):
                g = tuple(d[k - m + 1 : k + 1])
                s = (every[g] - own[g]) / (every[g[:-1]] - own[g[:-1]]) if every[g] > own[g] else 0.4 * s
            total += math.log(s)
        assert got[i].n_words == len(d) and got[i].log_score == pytest.approx(total, abs=1e-9)
    assert got[0].mean_log_score is None
    assert lm.score(frame(spark, [])).count() == 0
    assert lm.score(frame(spark, ["a b", "a b"], [None, None])).count() == 2


def test_packed_rows():
    rng = np.random.default_rng(0)
    for n in (1, 2, 1000):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (lm._unpack(lm._pack(h)) == h).all()
    dense = np.arange(5, 5000, dtype=np.uint64)
    assert (lm._unpack(lm._pack(dense)) == dense).all()


# -- 9 line dedup


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :])


def naive_lines(rows):
    first = {}
    for i, t in sorted(rows):
        for k, x in enumerate((t or "").split("\n")):
            if len(x) >= lines.MIN_CHARS:
                first.setdefault(x, (i, k))
    beaten = {x for x in first if any(first[y] < first[x] and one_edit(x, y) for y in first if y != x)}
    return {i: [k for k, x in enumerate((t or "").split("\n")) if x in first and (x in beaten or first[x] != (i, k))] for i, t in rows}


def test_lines_are_brute_force(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcé ") for _ in range(rng.choice([19, 20, 21, 40, 90]))) for _ in range(25)]
    for x in list(pool):
        k = rng.randrange(len(x))
        pool += [x[:k] + x[k + 1 :], x[:k] + "#" + x[k + 1 :], x[:k] + "##" + x[k:], x[:k] + "#" + x[k:]]
    texts = [None, "", "short", *("\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(60))]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in lines.line_counts(frame(spark, texts)).collect()}
    assert {i: r.removed for i, r in got.items()} == {i: ",".join(map(str, k)) for i, k in naive_lines(rows).items()}
    out = {r.doc_id: r for r in lines.dedup(frame(spark, texts)).collect()}
    for i, t in rows:
        kept = [x for k, x in enumerate((t or "").split("\n")) if k not in naive_lines(rows)[i]]
        if naive_lines(rows)[i] and not any(x.strip() for x in kept):
            assert i not in out
        else:
            assert (out[i].text or "") == "\n".join(kept) and (out[i].n_chars == len(out[i].text or ""))
    assert lines.line_counts(frame(spark, [])).count() == 0 and out[0].text is None
    same = "one and the same line of a document"
    odd = lines.line_counts(frame(spark, [same, same, same, same], [None, 4, 4, 6])).collect()
    assert sorted((r.doc_id or 0, r.removed) for r in odd) == [(0, ""), (4, ""), (4, ""), (6, "0")]


# -- 10 toxicity


def test_forward_backward_is_brute_force():
    rng = np.random.default_rng(0)
    e, starts, trans = rng.normal(size=9), np.array([0, 4, 5]), rng.normal(size=(2, 2))
    m, pairs, _ = toxicity.forward_backward(e, starts, trans)
    want, both = np.zeros(9), np.zeros((2, 2))
    for a, b in ((0, 4), (4, 5), (5, 9)):
        z = {s: math.exp(sum(e[a + k] * s[k] for k in range(b - a)) + sum(trans[x] for x in itertools.pairwise(s))) for s in itertools.product((0, 1), repeat=b - a)}
        for s, v in z.items():
            want[a:b] += np.array(s) * v / sum(z.values())
            for x in itertools.pairwise(s):
                both[x] += v / sum(z.values())
    assert np.allclose(m, want) and np.allclose(pairs, both)


def test_toxic_documents_and_spans(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(400):
        bad = k % 4 == 0
        w = [rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(40)]
        if bad:
            for _ in range(2):
                w[rng.randrange(40)] = rng.choice(["Scumbag", "vileword", "vilething"]) + rng.choice(["", "s"])
        rows.append(" ".join(w[:20]) + "\n" + " ".join(w[20:]))
        labels.append((k, 1, int(bad)))
    rows += [None, "", "clean words", "you vilethings go"]
    lab = spark.createDataFrame([*labels, labels[0], (None, 1, 1), (401, None, None)], "doc_id long, quality int, toxic int")
    d = frame(spark, rows)
    out = {r.doc_id: r for r in toxicity.score(d, toxicity.train(d, lab)).collect()}
    held = [k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(out[k].score >= 0.5) == bool(labels[k][2]) for k in held]) >= 0.98
    assert out[400].score < 0.5 and out[401].score < 0.5 and out[402].score < 0.5 and out[403].spans == "4:14"
    stay = {r.doc_id for r in toxicity.reject(d, lab).collect()}
    assert 403 not in stay and {400, 401, 402} <= stay
    none = toxicity.score(d, toxicity.train(d, lab.limit(0)))
    assert none.count() == len(rows) and none.where("score >= 0 AND score <= 1").count() == len(rows)
    assert toxicity.score(d.limit(0), toxicity.train(d, lab)).count() == 0


def test_toxic_fit_reads_whole_texts_and_keeps_class_shares(spark):
    rng = random.Random(2)
    words = [[rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(40)] for _ in range(300)]
    rows = [" ".join(w) for w in words]
    labels = spark.createDataFrame([(k, int(k % 10 == 0)) for k in range(300)], "doc_id long, toxic int")
    few = toxicity.Settings(sample=20)
    # nothing tells the classes apart: each document's score is the share of toxic ones among all labels
    scores = [r.score for r in toxicity.score(frame(spark, rows), toxicity.train(frame(spark, rows), labels, few)).collect()]
    assert max(scores) < 0.2
    # the passage is behind 20,000 characters
    filler = "\n".join(" ".join(WORDS) for _ in range(300)) + "\n"
    assert len(filler) > 20_000
    rows = [filler + r + (" you vilescum" if k % 10 == 0 else "") for k, r in enumerate(rows)]
    model = toxicity.train(frame(spark, rows), labels)
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(frame(spark, rows), model).collect()}
    assert got == {k: k % 10 == 0 for k in range(300)}
    sample = [(t, int(k % 10 == 0)) for k, t in enumerate(rows) if k % 10 in (0, 1)]
    a, b = toxicity.fit(sample, few), toxicity.fit(sample, few, (0.125, 1.0))
    assert b.calibration[0] - a.calibration[0] == pytest.approx(math.log(0.125)) and b.calibration[1:] == a.calibration[1:]


# -- pipeline


def test_line_dedup_with_clashing_names(spark):
    line = "the same line of text stands in all of these documents"
    docs = spark.createDataFrame([(1, line, "g", "k", 9, "w"), (2, line + "\nown words", "g", "k", 9, "w"), (None, line, "g", "k", 9, "w"), (3, None, None, None, None, None), (4, "", "", "", 0, "")], "doc_id long, text string, gone string, kept string, n_chars long, lines string")
    got = {r.doc_id: r for r in lines.dedup(docs).collect()}
    assert got[2].text == "own words" and got[2].n_chars == 9 and (got[2].gone, got[2].kept, got[2].lines) == ("g", "k", "w")
    assert got[1].text == line and got[None].text == line and got[3].text is None and got[4].text == "" and len(got) == 5
    long = spark.createDataFrame([(1, "\n".join(f"line number {k} of a long text" for k in range(20000))), (2, "\n".join(f"line number {k} of a long text" for k in range(0, 20000, 2)) + "\nnew")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup(long).collect()}[2] == "new"


def test_pipeline_runs_on_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    long = "\n".join(" ".join(f"w{a}x{b}" for b in range(40)) for a in range(700))
    rows = [(1, long, "en", "a", 1), (1, long, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "some words here", "en", "a", 3), (4, "the quick brown fox jumps over the lazy dog near it", None, "a", 9), (5, "the quick brown fox jumps over the lazy dog near it now", "en", None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, some in (("full", rows), ("none", [])):
        d = tmp_path / name
        spark.createDataFrame(some, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(4, 1, 0), (5, None, None)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "what is the sum of 3 km and 4 km then"), (None, None), (2, "")] if some else [], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        out = pipeline.run(spark, str(d)).collect()
        if not some:
            assert out == []
            continue
        assert {r.doc_id for r in out} == {None, 1, 2, 4} and sum(r.doc_id is None for r in out) == 1
        bins = defaultdict(int)
        for r in out:
            bins[r.sequence_id] += r.length
        assert max(bins.values()) <= 2048 and all(r.length >= 1 for r in out)


def test_pipeline_stages_act(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "best_fit_packing"]
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), None
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        before = docs.count() if before is None else before
    assert 0 < docs.count() < 200

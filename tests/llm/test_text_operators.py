"""Quality rules, personal data, winnowing, near duplicates and the classifier against brute force."""

import random
import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from tests.llm.conftest import DATA, bag

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_rule_counts(spark, docs, empty):
    from lodecast.llm.quality_rules import apply_rules

    labels = spark.createDataFrame([(i, 1) for i in range(0, 400, 2)] + [(None, 1), (4, None)], "doc_id long, quality int")
    found = apply_rules(docs, labels)
    expected = []
    for i, t in texts_of(docs):
        words = SPACE.findall(t)
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        seen = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        twice = {w for w, n in Counter(seen).items() if n > 1}
        repeated = len({k + j for k, w in enumerate(seen) if w in twice for j in range(5)})
        failed = len(words) < 10 or 100 * repeated > 20 * len(words)
        expected.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeated, failed))
    assert bag(r[:-1] for r in found.collect()) == bag(expected)
    assert found.where("base_failed AND kept").count() == 0
    assert apply_rules(empty, labels).collect() == []


def test_binomial_bound_and_cutoffs(spark):
    from math import comb

    from lodecast.llm.quality_rules import binomial_tail, certified_cutoffs

    rows = spark.createDataFrame([(n, k) for n in (1, 5, 80, 400) for k in range(0, n + 1, max(1, n // 7))], "n long, k long")
    for n, k, p in rows.select("n", "k", binomial_tail(F.col("n"), F.col("k"), 0.02)).collect():
        exact = sum(comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1))
        assert abs(p - (exact if k <= n * 0.02 else 1)) < 1e-9
    # 2000 good documents score at most 0.1, 50 bad ones 0.9: the cutoff parts them. Few labels certify nothing.
    base = {c: F.lit(-1) for c in ("_symbols", "_capitals", "_marks", "_repeats", "_lines")}
    made = spark.range(2050).select(F.col("id").alias("doc_id"), F.lit("en").alias("_stratum"), F.lit(100).alias("n_words"), F.lit(0).alias("n_repeat_words"), *(c.alias(n) for n, c in base.items()))
    made = made.withColumn("_symbols", F.when(F.col("doc_id") < 2000, F.lit(4)).otherwise(F.lit(44)))
    labels = spark.range(2050).select(F.col("id").alias("doc_id"), (F.col("id") < 2000).cast("int").alias("quality"))
    got = [tuple(r) for r in certified_cutoffs(made, labels).collect()]
    assert len(got) == 1 and got[0][:2] == ("en", "symbols") and 4 < got[0][2] <= 44
    assert certified_cutoffs(made, labels.where("doc_id % 50 = 0")).collect() == []


def test_cutoffs_of_each_stratum_against_sql(spark):
    """Two strata certify cutoffs, one has too few labels, one none; a null stratum counts as the empty one."""
    import duckdb

    from lodecast.llm.oracles import ORACLES
    from lodecast.llm.quality_rules import apply_rules

    rng = random.Random(3)
    rows = []
    for i in range(3600):
        bad = i % 9 == 0
        lang = None if i < 1700 else "yo" if i < 3400 else "km" if i < 3500 else "qu"
        words = [f"w{rng.randrange(10**6)}" + "#" * (rng.randint(2, 6) if bad else rng.random() < 0.1) for _ in range(rng.randint(5, 30))]
        rows.append((i, "\n".join(words) if i % 2 else " ".join(words), lang))
    rows += [(None, "# " * 12, "yo"), (3600, None, None), (3600, "a b c d e " * 6, "yo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 9 > 0)) for i in range(3500)] + [(5, None), (None, 0)], "doc_id long, quality int")
    found = apply_rules(docs, labels)
    with duckdb.connect() as db:
        for name, frame in (("documents", docs), ("labels", labels)):
            db.register(name, frame.toArrow())
        expected = db.execute(f"SELECT {', '.join(found.columns)} FROM ({ORACLES['op2_risk_controlled_rules']})").fetchall()
    assert bag(found.collect()) == bag(expected)
    langs = {i: lang for i, _, lang in rows}
    rejected = {langs[r["doc_id"]] for r in found.where("NOT kept AND NOT base_failed").collect()}
    assert rejected == {None, "yo"}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = [int(d) for d in m[0] if d.isdigit()]
            luhn = sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
            ok = {
                "email": True,
                "ip": kind == "ip" and max(map(int, m[0].split("."))) <= 255,
                "card": 14 <= len(digits) <= 19 and luhn % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            out += [(m.start(), place, kind, m.end())] * ok
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_personal_data(spark, docs, empty):
    from lodecast.llm.pii import BASE as KEPT
    from lodecast.llm.pii import find_personal_data, mask_personal_data

    own = [
        "a@b.c@d.e @b.c@d.e x@a@b.cc.",
        "1.2.3.4.5.6.7.8 999.1.2.3.4 00001.2.3.255",
        "4111 1111 1111 1111 x 4111-1111-1111-1111 5 4111111111111112",
        "+1 ((((...)) 234 567 8901 + +2 +1234567890123456",
        "é mail a..b%+-@x-.y--.z.",
        "IBAN: GB82 WEST 1234 5698 7654 32 AND MORE",
        "account DE89370400440532013000.",
        "ssn 123-45-6789",
        "order 123-45-6789",
    ]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(own)], "doc_id long, text string"))
    found = {}
    for r in find_personal_data(frame).collect():
        found.setdefault(r[0], [(s["kind"], s["start"], s["end"]) for s in r[1]])
    for i, t in texts_of(frame):
        assert [s for s in found[i] if s[0] in KEPT] == base_spans(t)
    assert ("iban", 6, 33) in found[1005] and found[1006][-1] == ("iban", 8, 30)
    assert found[1007] == [("national_id", 4, 15)] and found[1008] == []
    assert find_personal_data(empty).collect() == [] and mask_personal_data(empty).collect() == []
    masked = {r["doc_id"]: r["text"] for r in mask_personal_data(frame).collect()}
    assert masked[1007] == "ssn <NATIONAL_ID>" and masked[0] is None
    assert mask_personal_data(docs).columns == docs.columns


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_winnowing(spark, docs, empty, monkeypatch):
    from lodecast.llm import winnowing

    bench = [(i, t) for i, t in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    long = item_words(bench[0][1])
    bench += [(900, "Tiny item"), (901, ""), (902, None), (None, "the of"), (903, "word " * 40), (900, "Tiny item"), (904, "ONE")]
    extra = [" ".join(long[3:13]) + " tail", "x " + " ".join(long[2:11]), "pre tiny ITEM, tiny-item", " ".join(long) * 2]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(2000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    windows = {}
    for item, t in bench:
        words = item_words(t)
        size = min(10, len(words))
        for k in range(len(words) - size + 1 if words and item is not None else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(str(item))
    expected = []
    for i, t in texts_of(frame):
        words = item_words(t)
        hit, items = set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if own := windows.get(tuple(words[k : k + size])):
                    hit |= set(range(k, k + size))
                    items |= own
        expected.append((i, len(words), len(hit), len(items), sorted(items), len(hit) > 0))
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    for size in (4 << 20, 500):  # one index file, and several
        monkeypatch.setattr(winnowing, "INDEX_BYTES", size)
        found = winnowing.find_hits(frame, benchmark)
        assert bag(found.drop("spans").collect()) == bag(expected)
        assert all(sum(s["n"] for s in r["spans"]) == r["n_hit"] for r in found.collect())
    kept = winnowing.without_hits(frame, benchmark)
    assert bag(kept.select("doc_id").collect()) == bag((r[0],) for r in expected if not r[-1])
    assert winnowing.find_hits(empty, benchmark).collect() == []
    assert winnowing.find_hits(frame, benchmark.limit(0)).where("contaminated").count() == 0


def jaccard_classes(rows):
    sets = []
    for _, t in rows:
        w = SPACE.findall(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min([v for v in (least.get(top(k)), i) if v is not None], default=None)
    return [(i, least[top(k)], links[k]) for k, (i, _) in enumerate(rows)]


def test_near_duplicates(spark, docs, empty, monkeypatch):
    from lodecast.llm import lsh_forest

    base = " ".join(f"w{k}" for k in range(120)).split()
    copies = [" ".join([*base[:j], f"new{j}", *base[j + 1 :]]) for j in range(0, 120, 2)] + [" ".join(base)] * 3
    frame = docs.select("doc_id", "text").union(spark.createDataFrame([(3000 + i, t) for i, t in enumerate(copies)], "doc_id long, text string"))
    expected = bag(jaccard_classes(texts_of(frame)))
    for blocks in (256, 9):  # whole nodes, and nodes in blocks
        monkeypatch.setattr(lsh_forest, "BLOCK_SETS", blocks)
        found = lsh_forest.similar_classes(frame)
        assert bag(r[:3] for r in found.collect()) == expected
    assert lsh_forest.similar_classes(empty).collect() == []
    kept = lsh_forest.one_of_each(docs)
    assert kept.columns == docs.columns
    rows = texts_of(docs)
    ids = {c for _, c, _ in jaccard_classes(rows)}
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == sorted((i is None, i) for i in ids)


def test_shortening_stops_at_the_target_recall():
    from lodecast.llm.lsh_forest import matched_depth

    for s in (0.5, 0.8, 0.95):
        depth = matched_depth(s, 24, 8, 0.999)
        assert depth == 1 or 1 - (1 - s**depth) ** 24 >= 0.999
        assert depth == 8 or 1 - (1 - s ** (depth + 1)) ** 24 < 0.999


def test_prefixes_are_shortened_until_no_link_is_missed(spark):
    from lodecast.llm import lsh_forest

    # At the threshold, a pair is missed by the first prefix length once in ten million at most.
    assert (1 - lsh_forest.THRESHOLD ** lsh_forest.matched_depth(lsh_forest.THRESHOLD)) ** lsh_forest.TREES <= 1e-7
    # Pairs at a similarity of 180 / 222; prefixes of 8 in 6 trees meet for two thirds of them only.
    rows = []
    for g in range(60):
        words = [f"g{g}w{k}" for k in range(205)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join([*words[:184], *(f"g{g}x{k}" for k in range(21))]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    expected = bag(jaccard_classes(rows))
    assert sum(n for *_, n in expected) == 120
    assert bag(r[:3] for r in lsh_forest.similar_classes(frame, trees=6, recall=0.0).collect()) == expected
    assert bag(r[:3] for r in lsh_forest.similar_classes(frame).collect()) == expected


def test_quality_model(spark, docs, empty):
    from lodecast.llm.quality_model import keep_good, score

    own = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    rows = score(own, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum((r["score"] >= 0.7) == (r["quality"] == 1) for r in rows) / len(rows)
    assert right > 0.93
    # Labels of the held-out fold have no bearing on the scores.
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert bag(score(own, flipped).collect()) == bag(score(own, labels).collect())
    found = score(docs, labels)
    assert found.count() == docs.count() and found.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert score(empty, labels).collect() == [] and keep_good(empty, labels).collect() == []
    assert score(docs, labels.limit(0)).where("score = 0.5").count() == docs.count()


def test_risk_is_least_over_all_rows(spark):
    """The model's prior and risk are those of all unlabelled rows, whatever sample it starts from."""
    import numpy as np

    from lodecast.llm import quality_model as q

    rng = np.random.default_rng(5)
    good, bad = rng.uniform(0, 0.3, (400, 10)), rng.uniform(0, 0.45, (600, 10))
    everything = np.concatenate([good, rng.uniform(0, 0.3, (500, 10)), bad])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(everything)], "_id long, _x array<double>").repartition(4)
    margins = q._with_one(everything) @ np.ones(51)
    assert np.allclose(q._totals(rows, lambda x: np.array([len(x), (q._with_one(x) @ np.ones(51)).sum()]), 2), [len(everything), margins.sum()])
    start = q.fit(good, everything[::7], 0.4)
    found = q.minimise_over_all(start, good, rows, len(everything))
    a, b = q._with_one(good), q._with_one(everything)

    def risk(t):
        rest = np.logaddexp(0, b @ t).mean() - 0.4 * np.logaddexp(0, a @ t).mean()
        return 0.4 * np.logaddexp(0, -(a @ t)).mean() + max(0.0, rest) + q._penalty(a) / 2 * t @ t

    own = np.append(found.weights, found.bias)
    assert risk(own) <= risk(np.append(start.weights, start.bias))
    assert all(risk(own) <= risk(own + rng.normal(0, size, 51)) + 1e-9 for size in (1e-3, 1e-2, 0.1, 1) for _ in range(20))


def test_one_row_of_each_class_stays(spark):
    from lodecast.llm.lsh_forest import one_of_each

    words = [f"w{k}" for k in range(60)]
    near = [" ".join([*words[:k], f"new{k}", *words[k + 1 :]]) for k in (0, 59)]
    other = " ".join(f"v{k}" for k in range(9))
    rows = [(1, near[0]), (1, near[1]), (1, near[1]), (None, near[0]), (4, other), (4, other + " "), (None, "x y"), (None, "x y"), (None, "x  y"), (7, None), (7, None), (8, "")]
    frame = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, class_id int")
    kept = one_of_each(frame)
    assert kept.columns == frame.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    # Of the near copies one row of id 1, of the copies one of id 4, of the null ids one text; no words, no copies.
    assert sorted(map(str, (i for i, _ in found))) == sorted(map(str, [1, 4, None, 7, 8]))
    assert {t for i, t in found if i == 1} < set(near) and (7, None) in found and (8, "") in found
    assert one_of_each(frame.where("doc_id IN (7, 8)").dropDuplicates()).count() == 2


def test_labels_in_order_keep_what_shares_a_prefix(spark):
    from lodecast.llm import lsh_forest

    rng = random.Random(3)
    size = 1 + lsh_forest._WIDTH * 4
    sets = []
    for k in range(400):
        label = b"".join(bytes([t]) + bytes(rng.choice((0, 1)) if j % 2 == 0 else 7 for j in range(size - 1)) for t in range(3))
        sets.append((k.to_bytes(2, "big"), 5, label))
    frame = spark.createDataFrame(sets, "_set binary, _size int, _label binary").repartition(3)
    labels = [(label[t * size : (t + 1) * size], own) for own, _, label in sets for t in range(3)]
    for level in (2, 3, 4):
        heads = Counter(prefix[: 1 + lsh_forest._WIDTH * level] for prefix, _ in labels)
        wanted = {(p, o) for p, o in labels if heads[p[: 1 + lsh_forest._WIDTH * level]] > 1}
        trie = lsh_forest.tries(frame, 3, 4, level)
        got = {(bytes(r["_prefix"]), bytes(r["_set"])) for r in trie.collect()}
        assert wanted <= got <= set(labels) and len(got - wanted) <= 2 * trie.rdd.getNumPartitions()

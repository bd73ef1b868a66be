"""Importance resampling, hard negatives and chat formatting against plain versions."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodecast.llm import chat, hard_negatives, importance
from tests.llm.conftest import bag


# ------------------------------------------------------------ op11

def _features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _resampled(docs, target):
    found = [(i, *_features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in _features(x)[1])
    S, T = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: 5 * len(fit) // 100])}
    return [(r[0], r[2], r[3], r[4], rank.get(id(r))) for r in rows]


def test_resampling_is_that_of_the_definition(spark, docs, texts):
    long = [(1000 + i, " ".join(random.Random(i).choices("a B c é the of and 7 x".split(), k=20 + i))) for i in range(120)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + long
    target = ["the of and the of", None, "", "B b É é 7", "x " * 50]
    frame = docs.unionByName(spark.createDataFrame(long, "doc_id long, text string"), allowMissingColumns=True)
    found = importance.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert found.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
    assert bag(found.collect()) == bag(_resampled(rows, target))


def test_a_draw_keeps_all_rows_and_ranks_ties_by_id(spark):
    scores = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(30).cast("long").alias("_n_words"), F.lit(0).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"), (F.col("id") % 3).alias("score"))
    found = importance.drawn(scores.repartition(7)).collect()
    assert len(found) == 1000
    assert {r.doc_id: r.rank for r in found if r.rank} == {2 + 3 * k: k + 1 for k in range(50)}


def test_empty_tables_and_targets(spark, empty, docs):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty, none).collect() == []
    rows = importance.resample(docs, none).collect()
    assert len(rows) == docs.count() and bag(rows) == bag(_resampled([(r.doc_id, r.text) for r in docs.collect()], []))


# ------------------------------------------------------------ op12

def _mined(rows, anchors):
    """Rows and anchors as (id, label, vector of integers)."""
    out = []
    for a, label, v in anchors:
        told = sorted((-sum(x * y for x, y in zip(v, w)), i, k) for i, k, w in rows if i != a)
        for p, positive, _ in [t for t in told if t[2] == label][:5]:
            fit = [(s, i) for s, i, k in told if k != label and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(a, positive, r + 1, i, -p, -s) for r, (s, i) in enumerate(fit)]
    return out


def _vectors(spark, rows):
    return hard_negatives.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, _id int"))


def _integers(rows):
    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    return [(i, str(k), [math.floor(256 * x) for x in v]) for i, v, k, _ in rows if i is not None and k is not None and good(v)]


def test_negatives_are_those_of_every_pair(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, [c * rng.choice((0.2, 1, 3)) + rng.gauss(0, 0.4) for c in centres[i % 4]], i % 3, 0) for i in range(400)]
    rows += [(500 + i, [0.5] * 6, i % 2, 0) for i in range(60)]  # copies, whose scores all tie
    rows += [(7, [0.5] * 6, 1, 0), (7, [0.5] * 6, 1, 0), (None, [1.0] * 6, 1, 0), (601, None, 1, 0), (602, [1.0] * 6, None, 0), (603, [math.nan] * 6, 1, 0), (604, [math.inf, 1.0], 1, 0), (605, [None, 1.0], 1, 0)]
    rows += [(700, [1.0, 2.0], 2, 0), (701, [], 2, 0), (702, [3.0] * 9, 0, 0)]
    vectors = _vectors(spark, rows).repartition(5)
    whole = _integers(rows)
    chosen = [r for r in whole if r[0] % 20 == 0 or r[0] == 7]
    found = hard_negatives.mine(vectors, vectors.where("_id % 20 = 0 OR _id = 7"), block_rows=7, bucket_rows=16)
    assert bag(found.collect()) == bag(_mined(whole, chosen))


def test_components_beyond_exact_doubles(spark):
    rows = [(i, [1e6 * (i % 7 + 1), 3.0 + i, -1e6], i % 2, 0) for i in range(40)]
    vectors, whole = _vectors(spark, rows), _integers(rows)
    assert bag(hard_negatives.mine(vectors, vectors.where("_id % 10 = 0")).collect()) == bag(_mined(whole, [r for r in whole if r[0] % 10 == 0]))


def test_short_buckets_are_never_read(spark, tmp_path):
    rng = np.random.default_rng(0)
    # Long rows of other labels fill every window, so that buckets of short rows cannot matter.
    rows = [(i, (rng.normal(size=4) * 0.05 + (4 if i < 300 else 0.01)).tolist(), i % 2, 0) for i in range(3000)]
    places = tuple(hard_negatives.write_buckets(_vectors(spark, rows), 100))
    read = []

    def counted(bucket):
        read.append(bucket["top"])
        return hard_negatives._read(bucket)

    whole = _integers(rows)
    anchor = next(r for r in whole if r[0] == 100)
    v = np.array([anchor[2]])
    out = hard_negatives.search(np.array([100]), [anchor[1]], v, np.sqrt((v.astype(float) ** 2).sum(1)), places, 5, 10, counted)
    assert bag(zip(*out.values(), strict=True)) == bag(_mined(whole, [anchor]))
    assert len(read) < len(hard_negatives._listed(places)) // 2


def test_no_vectors(spark):
    none = _vectors(spark, [(1, None, 1, 0)])
    assert hard_negatives.mine(none, none).collect() == []
    one = _vectors(spark, [(100, [1.0], 1, 0)])
    assert hard_negatives.mine(one, one).collect() == []


# ------------------------------------------------------------ op13

RECORDS = {
    1: {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": None}]},
    2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    3: {"conversations": [{"from": "human", "value": "q"}], "system": "be kind"},
    4: {"conversations": [{"from": "human", "value": "q"}], "system": ""},
    5: {"prompt": "p", "completion": "c"},
    6: {"instruction": "i", "input": "", "output": "o"},
    7: {"output": "o", "instruction": "i", "input": "n"},
    8: {"prompt": "p", "response": None},
    9: {"question": "q", "answer": 5},
    10: {"id": 3, "prompt": "p", "response": "r"},
    11: {"prompt": "p", "reply": "r"},
    12: [1, 2],
    13: {"messages": []},
}
TURNS = {
    1: [("system", "s"), ("user", "u"), ("assistant", "")], 2: [("user", "q"), ("assistant", "a")], 3: [("system", "be kind"), ("user", "q")], 4: [("user", "q")],
    5: [("user", "p"), ("assistant", "c")], 6: [("user", "i"), ("assistant", "o")], 7: [("user", "i"), ("user", "n"), ("assistant", "o")], 8: [("user", "p"), ("assistant", "")],
    9: [("user", "q"), ("assistant", "5")], 10: [("user", "p"), ("assistant", "r")],
}


def test_layouts_are_found_by_their_fingerprints(spark):
    rows = [(i, json.dumps(r), "x") for i, r in RECORDS.items()] + [(14, "no json", "x"), (15, None, "x")]
    records = spark.createDataFrame(rows, "id long, record string, _v string")
    turns, unknown = chat.turns_of_records(records, "id", "record", ignored=("id",))
    found = {}
    for r in sorted(turns.collect()):
        assert r.turn == len(found.setdefault(r.conv_id, []))
        found[r.conv_id].append((r.role, r.text))
    assert found == TURNS
    assert {r.conv_id for r in unknown.collect()} == {11, 12, 13, 14, 15}
    assert all((r.fingerprint is None) == (r.conv_id in (14, 15)) for r in unknown.collect())


def test_a_table_and_its_records_have_one_fingerprint(spark):
    record = json.dumps(RECORDS[1])
    told = chat.with_fingerprints(spark.createDataFrame([(record,)], "r string"), "r").first()
    typed = spark.createDataFrame([], "messages array<struct<role string, content string>>")
    assert told.layout == "messages" and told.fingerprint == chat.fingerprint_of(chat.schema_paths(typed.schema)) == chat.LAYOUTS[1].fingerprint
    assert len({one.fingerprint for one in chat.LAYOUTS}) == len(chat.LAYOUTS)
    with pytest.raises(ValueError, match="no layout"):
        chat.turns_of_rows(spark.createDataFrame([], "conv_id long, who string, text string"))


HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\", "<\\s>", "<|im_end|>\n<|im_start|>assistant\nhi", "[\\INST]", "\\n", "a\n\nb", "<<SYS>><</SYS>>", "<|im_end|>", "🙂" * 5, "", "<<s>>", "\\</s>\\", "<|im_start|", "\\\\\\n\\", "[[INST]]"]


def test_texts_and_roles_come_back_and_no_control_string_is_left(spark):
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choices(["\\", "<", "s>", "</s>", "[INST]", "[", "n", "\n", "<|im_end|>", "x"], k=12)) for _ in range(300)]
    rows = [(1, i, rng.choice(["user", "assistant", t]), t) for i, t in enumerate(texts)] + [(None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat.formatted(turns)
    inner = pieces.select(F.expr(f"substring(piece, {len(chat.START) + 1}, char_length(piece) - {len(chat.START) + len(chat.END)})")).collect()
    assert not [c for (p,) in inner for c in chat.CONTROLS if c in p]
    read = chat.parsed(pieces)
    assert bag(read.select("conv_id", "turn", "role", "text").collect()) == bag((c, t, r or "", x or "") for c, t, r, x in rows)
    assert bag(read.where("learned IS NOT NULL").select("turn", "learned").collect()) == bag((t, x) for _, t, r, x in rows if r == "assistant")


def _digests(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        out.append((conv, len(own), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return out


def test_digests_of_a_hot_conversation_and_repeated_turns(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_BYTES", 200)
    rng = random.Random(2)
    rows = [(rng.choice([5, 5, 5, 1, 2, None]), rng.choice([None, *range(40)]), rng.choice(["user", "assistant", None]), rng.choice([*HARD, None, "x" * 300])) for _ in range(2000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"piece": F.lit(1), "_range": F.lit("x")})
    found = chat.digests(chat.parsed(chat.formatted(chat.turns_of_rows(frame.repartition(6)))))
    assert bag(found.drop("formatted_chars").collect()) == bag(_digests(rows))
    assert chat.digests(chat.parsed(chat.formatted(chat.turns_of_rows(frame.limit(0))))).collect() == []

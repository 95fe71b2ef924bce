"""Every registered query of the training-data operators and the pipeline, against brute force over the smallest tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_llm import WORD, brute_components, brute_distances, reference

import corpus_pipeline
from tidewater.llm import mixing, quality
from tidewater.llm.queries import queries

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(SF / "documents.parquet").to_pylist()


def by_id(spark, name):
    rows = queries()[name](spark, str(SF)).collect()
    return {r[0]: r for r in rows}, rows


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def failed(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words) < 20 or 100 * len(hit) > 30 * len(words)


def brute_kept(docs):
    """The verdicts of the quality rules: base rules and the fences of the distances by length."""
    rows = [(d["doc_id"], d["text"], d["lang"]) for d in docs]
    far = brute_distances(rows)
    count = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sound = [not failed(t) for _, t, _ in rows]
    band = [int(np.floor(np.log2(max(1, n)))) for n in count]
    chars = [len(re.sub(r"[ \t\r\x0b\x0c]", "", t or "")) for _, t, _ in rows]
    kept = list(sound)
    # Languages with too few sound documents have no reference, and theirs are not asked.
    sizes = Counter(r[2] for r, x in zip(rows, sound) if x)
    known = [r[2] is None or sizes[r[2]] >= quality.MIN_DOCS for r in rows]
    chars, count = ([x if k else 0 for x, k in zip(v, known)] for v in (chars, count))
    for which, asked, times, margin in ((0, [c >= quality.MIN_CHARS for c in chars], quality.CLASS_FENCE, quality.CLASS_MARGIN), (1, [n >= quality.MIN_WORDS for n in count], quality.WORD_FENCE, quality.WORD_MARGIN)):
        last = None
        for b in range(64):
            own = sorted(int(np.floor(far[i][which] * quality.STEPS)) / quality.STEPS for i in range(len(rows)) if band[i] == b and sound[i] and asked[i])
            if len(own) >= quality.MIN_BAND:
                low, high = (own[int(np.ceil(q * len(own))) - 1] for q in (0.25, 0.75))
                last = high + max(margin, times * (high - low))
            for i in range(len(rows)):
                if band[i] == b and asked[i] and last is not None and far[i][which] > last:
                    kept[i] = False
    return kept


def test_op1(spark, docs):
    got, rows = by_id(spark, "op1_mix_sources")
    size = {d["doc_id"]: len(WORD.findall(d["text"] or "")) for d in docs}
    total = Counter()
    for d in docs:
        total[d["source"]] += size[d["doc_id"]]
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while True:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * share > 3 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
        open_ -= over
    target |= {s: weight[s] * share for s in open_}
    taken = Counter()
    for d in docs:
        r = got[d["doc_id"]]
        assert (r["size"], r.source_size) == (size[d["doc_id"]], total[d["source"]]) and r.target == pytest.approx(target[d["source"]])
        rate = target[d["source"]] / total[d["source"]]
        draw = int(hashlib.md5(f"17:{d['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        assert r.taken == r["size"] * (int(rate) + (draw < rate % 1)) <= 3 * r["size"]
        taken[d["source"]] += r.taken
    assert sum(abs(taken[s] - target[s]) for s in names) < 0.2 * sum(target.values())
    assert rows == queries()["op1_mix_sources"](spark, str(SF)).collect()


def test_op2(spark, docs):
    got, ids = queries()["op2_token_store"](spark, str(SF)).collect(), reference("word_bpe_49k.json")
    want, at = [], 0
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        x = np.append(ids(d["text"]), 1).astype("<u4")
        want.append((d["doc_id"], at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(tuple(r[:4]) for r in got) == want


def test_op3(spark, docs):
    got, groups = by_id(spark, "op3_exact_dedup")[0], {}
    for d in docs:
        groups.setdefault(norm(d["text"]), []).append(d["doc_id"])
    for text, ids in groups.items():
        for i in ids:
            assert tuple(got[i])[:5] == (i, min(ids), len(ids), i == min(ids), hashlib.sha256(text.encode()).hexdigest())


def test_op4(spark, docs):
    got = queries()["op4_ngram_jaccard"](spark, str(SF)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components([(d["doc_id"], d["text"]) for d in docs])


def test_op5(spark, docs):
    got = by_id(spark, "op5_quality_rules")[0]
    for d, kept in zip(docs, brute_kept(docs)):
        assert got[d["doc_id"]].base_failed == failed(d["text"]) and got[d["doc_id"]].kept == kept, d["doc_id"]


def test_op6(spark, docs):
    got = by_id(spark, "op6_toxicity")[0]
    for d in docs:
        r = got[d["doc_id"]]
        assert r.held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(SF / "labels.parquet").to_pylist()}
    learned = [(got[i].predicted, y) for i, y in toxic.items() if not got[i].held_out]
    assert np.mean([a == b for a, b in learned]) > 0.95


def test_op7(spark, docs):
    got = by_id(spark, "op7_personal_data")[0]
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0
    for d in docs:
        t, r = d["text"] or "", got[d["doc_id"]]
        base = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        base += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        base += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        base += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in base) for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        place = {"email": 0, "ip": 1, "card": 2, "phone": 3, "secret": 4}
        assert set(listed) <= set(r.spans.split(",")) or not listed
        assert spans == sorted(spans, key=lambda s: (place[s[0]], s[1], s[2])) and len(spans) == r.n_spans == len(base) + r.n_added
        for m in re.finditer(r'token = "([0-9a-fA-F]{40})"', t):
            assert ("secret", *m.span(1)) in spans


def test_op8(spark):
    pages = pq.read_table(SF / "pages.parquet").to_pylist()
    got, last = by_id(spark, "op8_warc_segments")[0], {}
    for p in pages:
        last[p["html"] or ""] = max(last.get(p["html"] or "", p["page_id"]), p["page_id"])
    for p in pages:
        raw, i = (p["html"] or "").encode(), p["page_id"]
        win = last[p["html"] or ""]
        assert tuple(got[i])[:5] == (i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == win else "revisit", None if i == win else win)


def check_packing(rows, texts, by_start=True):
    """Pieces partition each document's ids, sequences are gapless and hold 1024 at most."""
    ids, room, seen = reference("byte_bpe_50k.json"), {}, {}
    for r in rows:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, []).append(r)
    assert sorted(room) == list(range(len(room)))
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    for i, (text, copies) in texts.items():
        x = np.append(ids(text), 0).astype("<u4")
        want = Counter((a, min(1024, len(x) - a), zlib.crc32(x[a : a + 1024].tobytes()), len(x)) for a in range(0, len(x), 1024))
        assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in seen.get(i, [])) == Counter({k: n * copies for k, n in want.items() if copies})
    return sum(r.length for r in rows) / (1024 * len(room))


def test_op9(spark, docs):
    rows = queries()["op9_pack_sequences"](spark, str(SF)).collect()
    assert check_packing(rows, {d["doc_id"]: (d["text"], 1) for d in docs}) > 0.95


def test_op10(spark, docs):
    got = by_id(spark, "op10_language_codes")[0]
    for d in docs:
        r = got[d["doc_id"]]
        assert r.held_out == (zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, d["text"] or "")))
    assert np.mean([got[d["doc_id"]].lang_pred == d["lang"] for d in docs if got[d["doc_id"]].held_out and got[d["doc_id"]].lang_pred != "und"]) > 0.95


def test_pipeline(spark, docs):
    every = {d["doc_id"]: d for d in docs}
    left = [d["doc_id"] for d, k in zip(docs, brute_kept(docs)) if k]
    groups = {}
    for i in left:
        groups.setdefault(norm(every[i]["text"]), []).append(i)
    left = sorted(min(g) for g in groups.values())
    comp = {i: c for i, _, c in brute_components([(i, every[i]["text"]) for i in left])}
    left = [i for i in left if comp[i] == i]
    table = spark.createDataFrame([(i, every[i]["text"], every[i]["source"]) for i in left], "doc_id long, text string, source string")
    sized = table.select("source", mixing.word_count(F.col("text")).alias("size"))
    rate = {r.source: r.rate for r in mixing.plan_mix(sized).collect()}
    copies = {}
    for i in left:
        r = rate[every[i]["source"]]
        copies[i] = int(r) + (int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) / 2**52 < r % 1)
    rows = corpus_pipeline.run(spark, str(SF)).collect()
    check_packing(rows, {i: (every[i]["text"], copies[i]) for i in left})
    assert {r.doc_id for r in rows} == {i for i in left if copies[i]}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, place long, first string, label string, keep_id int"
    text = "the river of stone and light in the house by the sea is calm and the wind of the night is not as it was on that day"
    rows = [(1, text, "en", "a", 1, 1, "x", "y", 1), (1, text, "en", "a", 1, 2, "x", "y", 1), (None, text + " too", "en", None, 1, 1, "x", "y", 1), (None, None, None, None, None, None, None, None, None), (2, "", "en", "a", 1, 1, "x", "y", 1)]
    for some in (rows, []):
        df = spark.createDataFrame(some, schema).repartition(2)
        out = stage(spark, df, str(SF))
        found = out.collect()
        if name != "packing":
            assert out.columns == df.columns and len(found) <= 3 * len(some)
        else:
            assert len({(r.sequence_id, r.offset) for r in found}) == len(found) == len(some)

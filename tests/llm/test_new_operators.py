"""Alignment, fingerprints and phrases against brute force, and on odd rows."""

import dataclasses
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ability_engine.llm import align, common, features, phrases, quality_model, secrets, spots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, links string, d string, words string"
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BACK = {chr(b): b for b in _PRINTABLE} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def tokens(text):
    """(id, bytes) of both sides by the libraries themselves."""
    a = A.encode(" " + text, add_special_tokens=False)
    left = [(k, bytes(_BACK[c] for c in t)) for k, t in zip(a.ids, a.tokens, strict=True)]
    right = [(k, bytes([int(B.id_to_piece(k)[3:-1], 16)]) if B.is_byte(k) else B.id_to_piece(k).replace("▁", " ").encode()) for k in B.encode(text)]
    whole = (" " + text).encode()
    return (left, right) if text and b"".join(b for _, b in left) == whole == b"".join(b for _, b in right) else ([], [])


def spans(side):
    out, at = [], 0
    for k, b in side:
        out.append((k, at, at + len(b)))
        at += len(b)
    return out


def aligned(text):
    """(n_a, n_b, groups as text, links) of a text."""
    a, b = map(spans, tokens(text or ""))
    links = [(x, y) for x, s, e in a for y, u, v in b if s < v and u < e]
    shared, groups = sorted({e for *_, e in a} & {e for *_, e in b}), []
    for low, high in zip([0, *shared], shared, strict=False):
        groups.append(",".join(str(k) for k, s, _ in a if low <= s < high) + "|" + ",".join(str(k) for k, s, _ in b if low <= s < high))
    return len(a), len(b), ";".join(groups), links


def texts():
    rng = random.Random(4)
    parts = ["the", "of", " ", "  ", "\n", "\n\n", "\t", "thonning", "antidis", "éçré", "Über", ".", ",", "!!", "1234", "don't", "漢字", "▁", "<s>", "<|endoftext|>", "\x1c", "\xa0", "Ininging", "###", "\U0001f600"]
    return [None, "", " ", "\n", "a", " a", "a ", "▁x", "x  y", "x \n y", "a\x85b", "\x00 z", "the the the", "same text", "same text", *["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(120)], "thonning of the wheresh. " * 400]


def table(spark, lines, ids=None):
    rows = [(k if ids is None else ids[k], t, "en", None, len(t or ""), 7, "x", "y", "w") for k, t in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA)


def expected(lines):
    found = [aligned(t) for t in lines]
    count = Counter(pair for *_, links in found for pair in set(links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for n_a, n_b, groups, links in found:
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        out.append((n_a, n_b, groups.count(";") + 1 if n_a else 0, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    return out


@pytest.mark.parametrize(("head", "block"), [(400_000, 100_000), (3, 100), (0, 7)])
def test_alignment_by_brute_force(spark, head, block):
    """Whatever is broadcast and however long texts are cut, nothing changes."""
    lines = texts()
    want = expected(lines)
    got = {r.doc_id: tuple(r)[1:] for r in align.report(table(spark, lines), head_rows=head, block_chars=block).collect()}
    assert len(got) == len(lines)
    for k, row in enumerate(want):
        assert got[k] == row, lines[k]


def test_alignment_keeps_odd_rows(spark):
    lines, ids = ["same", "same", None, "x"], [None, None, 1, 1]
    got = align.report(table(spark, [*lines, "long " * 50_000], [*ids, 1]), block_chars=10_000).collect()
    assert len(got) == 5
    long = next(r for r in got if r.n_a > 1000)
    assert sorted((tuple(r) for r in got if r is not long), key=str) == sorted(((d, *row) for d, row in zip(ids, expected(lines), strict=True)), key=str)
    assert long.n_a == len(tokens("long " * 50_000)[0]) and long.n_links == long.n_a + long.n_b - long.n_groups == long.n_best
    assert align.report(table(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet="aBé ÀzZ'sst're\n\t  \xa0  09²#*$%.,!?_-ß\x1c\x85œ<|endoftext|>▁漢", max_size=60) | st.text(max_size=40))
def test_stretches_give_the_libraries_ids(text):
    both = align.both()
    found = [both[s] for s in align.stretches(text)]
    both.learn()
    a, b = (b"".join(side[k] for k in found) for side in (both.a, both.b))
    left, right = tokens(text)
    if left:
        assert not both.bad & set(found)
        assert [k for k, _ in left] == list(memoryview(a).cast("H")) and [k for k, _ in right] == list(memoryview(b).cast("H"))
    else:
        assert not text or both.bad & set(found)


def mined(rows, least, depth, top):
    """The contract of the phrases, word for word."""
    f, n, out = Counter(), Counter(), []
    for _, text, lang in rows:
        lang, text = lang or "und", "".join(c.lower() if c.isascii() else c for c in text or "")
        for c in ".,;:!?\x0b\x0c\r":
            text = text.replace(c, "\n")
        for piece in text.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[k : k + size])) for size in range(1, depth + 1) for k in range(len(words) - size + 1))
    cands = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    within = lambda p, q: any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))
    for (lang, p), a in cands.items():
        if any(x == lang and len(q) > len(p) and b >= a and within(p, q) for (x, q), b in cands.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    kept = []
    for lang in n:
        some = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        kept += [(lang, k + 1, *r[1:]) for k, r in enumerate(some[:top])]
    return sorted(kept)


@pytest.mark.parametrize(("shard", "hot"), [(1_500_000, 5_000), (40, 5_000), (200, 10), (90, 2)])
def test_phrases_by_brute_force(spark, shard, hot):
    """Shards of any size, hot words and hot pairs give one result."""
    rng = random.Random(9)
    words = ["the", "of", "a", "New", "york", "city", "é", "é\x01", "x\x1fy", "zz"]
    made = [(k, "".join(rng.choices(words, [9, 6, 5, 4, 4, 3, 2, 1, 1, 2])[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None])) for k in range(80)]
    made += [(99, None, "en"), (99, None, None), (None, "New York City", "en"), (None, "New York City", "en"), (100, "the of " * 300, "en"), (101, "only here", "fr"), *[(k, "big big apple pie now", "es") for k in range(8)]]
    rows = [(d, t, lang, None, 0, 1, "x", "y", "w") for d, t, lang in made]
    got = phrases.mine(spark.createDataFrame(rows, SCHEMA), least=5, depth=5, top=30, shard_words=shard, hot_share=hot)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == mined(made, 5, 5, 30)


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert phrases.mine(empty).count() == 0
    assert phrases.mine(table(spark, [None, "", "one two", "..."])).count() == 0


def test_phrase_scores_pass_64_bits(spark):
    a, n = 9 * 10**12, 8 * 10**14
    exact = spark.createDataFrame([(a, n, 3 * 10**13, 2 * 10**13)], "a long, n long, l long, r long").select(F.expr(phrases.SCORE).alias("score")).first().score
    assert exact == 1000 * a * n // (3 * 10**13 * 2 * 10**13)


def test_fingerprints_by_hand(spark):
    lines = ["The cat of the house sat", None, "", "The cat of the house sat", "... !", "dog " * 3, "the " * 20_000 + "end"]
    rows = spots.report(table(spark, lines)).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(lines)
    digest = lambda *w: hashlib.md5(" ".join(w).encode()).hexdigest()[:8]
    common = set(spots.anchors(table(spark, lines)))
    for k, text in enumerate(lines):
        words = [w.lower() for w in (text or "").split() if w.isalnum()]
        want, content = set(), [w for w in words if w not in common]
        if words:
            want.add(digest("^", *words[:2]))
        before = 0
        for p, w in enumerate(words):
            if w in common:
                want.add(digest(w, *content[p - before : p - before + 2]))
                before += 1
        assert got[k].fingerprint == "".join(sorted(want)), k
        follow = lines[(k + 1) % len(lines)] or ""
        n = len(text or "")
        edited = (text or "")[: n - n // 4] + follow[: n // 4]
        assert got[k].n_chars == n and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[0].fingerprint == got[3].fingerprint and got[1].fingerprint == "" and got[1].near_next == 1.0 and got[3].near_next == 0.0


def test_likeness_and_its_partitions(spark):
    rng = random.Random(2)
    pairs = [(sorted({str(rng.randrange(n)) for _ in range(n)}), sorted({str(rng.randrange(n)) for _ in range(m)})) for n in (1, 4, 30, 200) for m in (0, 1, 5, 29, 250, 2500)]
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", spots.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    for r in rows:
        a, b = set(r.a), set(r.b)
        true = len(a & b) / len(a | b)
        assert r.x == (0.0 if min(len(a), len(b)) < 0.1 * max(len(a), len(b)) else pytest.approx(true))


def test_fingerprints_keep_odd_rows(spark):
    lines, ids = ["same text of it", "same text of it", "other", None, "x y", ""], [None, 1, 1, 1, 2, 2]
    docs = table(spark, lines, ids).unionByName(table(spark, ["twin", "twin"], [5, 5]))
    got = spots.report(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(map(str, [*ids, 5, 5]))
    twins = [r for r in got if r.doc_id == 5]
    assert twins[0] == twins[1]
    assert spots.report(table(spark, [])).count() == 0
    one = spots.report(table(spark, ["alone in the world"])).first()
    assert one.near_next == 1.0


def test_ledger_runs_again(spark, tmp_path):
    """A hot blob, a second run without texts in a shuffle, a new version of a rule and a new version of a document."""
    path = str(tmp_path / "ledger")
    hot = spark.range(100_000).select("id", F.lit("token = abcdef123 end").alias("text"))
    docs = hot.unionByName(spark.createDataFrame([(-1, "AKIA" + "Z" * 20), (-2, None), (-3, "plain")], "id long, text string")).withColumnRenamed("id", "doc_id")
    first = secrets.update(docs, path)
    assert first.count() == 4 and secrets.scan(docs, first).count() == 0
    assert secrets.due(docs, first).count() == 0
    newer = (*secrets.RULES[:-1], dataclasses.replace(secrets.RULES[-1], version=2))
    for most in (0, 200_000):  # beyond the broadcast, and within
        again = secrets.scan(docs, first, newer, broadcast_rows=most).collect()
        assert len(again) == 4 and all(r.scanned == ["jwt@2"] for r in again)
    changed = docs.unionByName(spark.createDataFrame([(-1, "AKIA" + "Y" * 20)], "doc_id long, text string"))
    assert [r.findings[0].kind for r in secrets.scan(changed, first).collect()] == ["access"]
    ledger = secrets.update(changed, path)
    found = secrets.report(changed, ledger)
    assert found.count() == 100_004 and found.where("doc_id >= 0 and findings[0].kind = 'assign'").count() == 100_000


def test_quality_learns_from_all_labels(spark):
    """Forty kinds of poor text, of which a sample of twenty rows sees a few; each labelled row is in a shard, and rare ones in several."""
    kinds = [" ".join(f"{chr(97 + k % 26)}{k}{w}" for w in ("spam", "deal", "win", "now")) for k in range(40)]
    made = [(k, kinds[k // 2 % 40] + f" {k}" if k % 2 else f"plain words of a report {k % 7}", k % 2) for k in range(320)]
    docs = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - poor) for k, _, poor in made] + [(0, None), (999, 1)], "doc_id long, quality int")
    model = quality_model.train(docs, labels, rows=20)
    good = sum(r.predicted == 1 - r.doc_id % 2 for r in quality_model.score(docs, model).collect())
    seen = features.shards(docs, labels, "quality", 20, least=1).collect()
    assert sum(len(r.x) for r in seen) == 320 and sum(sum(r.label) for r in seen) == 160 and sorted(r.shard for r in seen) == list(range(17))
    rare = labels.where("doc_id % 2 = 0 or doc_id < 6")
    seen = features.shards(docs, rare, "quality", 20).collect()
    assert all(0 in r.label for r in seen) and sum(list(r["copy"]).count(0) for r in seen) == 163
    assert good >= 310, good


def test_shards_are_never_one_row(spark):
    """A shard of more than SLICE texts is in several rows, and the fit of a shard still gets all of them, also where two shards are read by one task."""
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of a text "), F.col("id") % 9).alias("text"))
    known = features.shards(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")), "quality", 1250)
    assert max(len(r.x) for r in known.collect()) <= common.SLICE
    schema = common.struct_of(*((name, T.IntegerType()) for name in ("shard", "n", "good")))
    seen = quality_model._each(known.coalesce(1), lambda shard, x, y, copy: {"shard": [shard], "n": [len(x)], "good": [int(y.sum())]}, schema).collect()
    assert sorted(r.shard for r in seen) == [0, 1] and sum(r.n for r in seen) == 2500 and sum(r.good for r in seen) == 1250
    assert all(r.n > common.SLICE for r in seen)

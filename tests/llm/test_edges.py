"""Brute-force versions of what SQL can't say, and nulls, empty, very long, tied, repeated and clashing rows for every operator and stage."""

import hashlib
import heapq
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ability_engine.llm import chat, decontaminate, language, lm, neardup, packing, quality_model, quality_rules, secrets, tokenfile
from ability_engine.llm.features import features, sigmoid, sparse

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
CLASH = "doc_id long, text string, lang string, source string, n_chars long, key long, words string, _key int, _once int, _blob int, _spans int, _may int, score double"


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null, empty and very long texts, ties, and columns with the names that operators use."""
    long = " ".join(f"w{k % 1999}" for k in range(60_000))
    texts = [(None, " ".join(WORDS * 5)), (None, None), (1, None), (1, ""), (1, "same text here"), (1, "same text here"), (2, "same text here"), (3, long), (4, " ".join(WORDS * 5)), (5, "\U00030000\U00030001"), (6, "token = 'abcdef12' end")]
    rows = [(d, t, "en", None, len(t or ""), 7, "w", 1, 2, 3, 4, 5, 0.5) for d, t in texts]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (4, 1, 0), (6, 0, 1), (None, 1, 0), (2, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(WORDS[:12])), (1, " ".join(WORDS[:12])), (2, "here"), (None, "text"), (3, None)], "item_id long, text string")


def test_every_operator_keeps_odd_rows(spark, odd, labels, bench, tmp_path):
    n = odd.count()
    tokenfile.write_tokens(odd, str(tmp_path / "t"))
    found = {
        "pack": packing.pack(odd, ids=False).where("start = 0"), "near": neardup.components(odd), "leaks": decontaminate.report(odd, bench), "rank": quality_model.score(odd, quality_model.train(odd, labels)), "tokens": tokenfile.read_tokens(spark, str(tmp_path / "t")),
        "secrets": secrets.digest(secrets.report(odd, secrets.update(odd, str(tmp_path / "l")))), "rules": quality_rules.judge(odd, quality_rules.train(odd, labels)), "lm": lm.score(odd, F.col("doc_id") > 1), "language": language.predict(odd, *language.train(odd, F.col("doc_id") > 1)),
    }
    want = sorted(str(r.doc_id) for r in odd.collect())
    for name, df in found.items():
        got = sorted(str(r.doc_id) for r in df.select("doc_id").collect())
        assert got == want and len(got) == n, name
    leaks = {(r.doc_id, r.n_words): r for r in found["leaks"].collect()}
    assert leaks[1, 3].n_hit == 2 and leaks[1, 3].n_items == 1 and leaks[4, 120].n_items == 1  # a null item counts in hits, not in items
    assert {r.doc_id: r.lang_pred for r in found["language"].collect()}[5] == "en"  # letters of the third plane


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_every_stage_on_odd_and_on_empty_tables(spark, odd, labels, bench, tmp_path, stage):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, odd.limit(0)):
        got = stage(spark, docs, str(tmp_path))
        rows = got.collect()
        if stage is corpus_pipeline.packing_stage:
            assert sum(len(r.ids) // 2 for r in rows) == sum(r.length for r in rows) and sum(r.start == 0 for r in rows) == docs.count()
            continue
        assert got.columns == docs.columns
        kept = sorted(((r.doc_id, r.text) for r in rows), key=str)
        texts = {r.text for r in docs.collect()}
        if stage is corpus_pipeline.near_duplicate_stage and docs is odd:
            assert len(kept) == 8 and {t for _, t in kept} == texts
        elif stage is corpus_pipeline.decontamination_stage and docs is odd:
            assert {d for d, _ in kept} == {None, 1, 3, 5, 6} and len(kept) == 6
        elif stage is corpus_pipeline.secret_stage and docs is odd:
            assert len(kept) == docs.count() and [t for d, t in kept if d == 6] == ["[secret]' end"]
        elif docs is not odd:
            assert kept == []


def test_secrets_by_brute_force(spark):
    rng = np.random.default_rng(5)
    parts = ["password", "Passwd", "SECRET", "api_key", "apikey", "token", ":", "=", " ", "'", '"', "abc123", "AKIA", "A" * 17, "Z9" * 8, "deadbeef" * 3, "0" * 24, "é", "\n", "x"]
    made = [(k, "".join(parts[int(i)] for i in rng.integers(0, len(parts), 60))) for k in range(150)] + [(200, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assign = r"""(?:p(?:assword|asswd)|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for r in secrets.digest(secrets.report(docs, secrets.scan(docs))).collect():
        text, spans = dict(made)[r.doc_id] or "", []
        for order, (kind, pattern, flags, group, least) in enumerate((("assign", assign, re.I | re.A, 1, 6), ("access", "AKIA[A-Z0-9]+", 0, 0, 20), ("hex", "[0-9a-f]+", 0, 0, 24))):
            at = 0
            while m := re.compile(pattern, flags).search(text, at):
                at = m.end()
                if len(m[group]) >= least:
                    spans.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
        want = ",".join(s for *_, s in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == o for _, k, _ in spans) for o in range(3))
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize("seed", range(6))
def test_packing_takes_the_cheapest_sequence(seed):
    """The plan against a walk that looks at every sequence."""
    rng = np.random.default_rng(seed)
    lengths, capacity = rng.integers(1, 150, 60).tolist(), 64
    rests = sorted(((n % capacity, d) for d, n in enumerate(lengths) if n % capacity), key=lambda r: (-r[0], r[1]))
    full = sum(n // capacity for n in lengths)
    total = sum(n for n, _ in rests)
    rooms = [capacity] * (total // capacity) + [1 << b for b in range(10, -1, -1) if total % capacity >> b & 1]
    costs, put = [0.0] * len(rooms), []
    for n, d in rests:
        fit = [k for k in range(len(rooms)) if rooms[k] >= n]
        if fit:
            k = min(fit, key=lambda k: (costs[k], k))
            rooms[k], costs[k] = rooms[k] - n, costs[k] + n + n * n / 2048
            put.append((d, n, full + k))
    found = packing.plan(lengths, capacity)
    assert put == [(d, n, s) for d, start, n, s, _ in found if n < capacity and start + n == lengths[d]][: len(put)]
    assert sum(n for _, _, n, _, _ in found) == sum(lengths)


def test_open_sequences_in_order():
    rooms, heap = packing.Open(5, 16), [(0.0, k) for k in range(5)]
    rng = np.random.default_rng(0)
    free = {k: 16 for k in range(5)}
    for n in rng.integers(1, 6, 20).tolist():
        want = min(((c, k) for c, k in heap if free[k] >= n), default=None)
        got = rooms.take(n)
        assert (got is None) == (want is None)
        if got is None:
            break
        assert (got[0], got[1]) == want
        heap.remove(want)
        free[want[1]] -= n
        heapq.heappush(heap, (want[0] + n, want[1]))
        rooms.put(want[0] + n, want[1], free[want[1]])


def test_features_and_scores_by_hand():
    text = "good words and good words again"
    x = features(text)
    data = sparse(x)
    at, values = np.frombuffer(data, "<u2").reshape(2, -1)
    back = np.zeros_like(x)
    back[at] = values.view("<f2")
    assert np.allclose(back, x, atol=1e-3) and abs((x[:2048] ** 2).sum() - 1) < 1e-5
    rng = np.random.default_rng(1)
    a, b = rng.random((40, 6)).astype(np.float32), rng.random((40, 6)).astype(np.float32) + 0.5
    both, y = np.vstack([a, b]), np.repeat([0.0, 1.0], 40)
    model = quality_model.fit(both, y, np.ones(80), pairs=4000)
    loss = lambda w: -np.log(sigmoid((b[:, None] - a[None]).reshape(-1, 6) @ w)).mean()
    assert loss(model.weights) < 0.75 * loss(np.zeros(6))
    # The cut is the share of poor rows among the scores.
    assert abs((model.score(both) < quality_model.CUT).mean() - 0.5) < 0.15


def test_quality_counts_by_brute_force(spark):
    texts = ["a #b# $ %", "x\nx\n\n x\nx", "one two three one two three", "* " * 60, "a\tb\x0bc\x0cd", " ".join(WORDS * 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.judge(docs, None).collect():
        text = texts[r.doc_id]
        lines, seen, dup = text.split("\n"), set(), 0
        for line in lines:
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text)) and r.n_dup_lines == dup


def test_language_by_brute_force(spark):
    made = [(k, ("the cat sat", "die katze sass", "le chat")[k % 3] + " ab"[: k % 4], ("en", "de", "fr")[k % 3]) for k in range(30)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")

    def vector(text):
        letter = lambda c: np.random.default_rng(c).integers(0, 2, language.DIM) * 2 - 1
        codes = [0]
        for c in text.lower():
            code = ord(c) if c.isalpha() else 0
            if code or codes[-1]:
                codes.append(code)
        codes += [0] * (codes[-1] != 0)
        out = sum(np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
        return out / np.linalg.norm(out)

    prototypes = {lang: sum(vector(t) for _, t, x in made if x == lang) for lang in ("de", "en", "fr")}
    prototypes = {k: v / np.linalg.norm(v) for k, v in prototypes.items()}
    for r in language.predict(docs, *language.train(docs, F.lit(True))).collect():
        cosines = {k: float(v @ vector(made[r.doc_id][1])) for k, v in prototypes.items()}
        assert r.lang_pred == max(cosines, key=cosines.get) and r.score == pytest.approx(max(0.0, cosines[r.lang_pred]), abs=1e-4)
    tied = language.predict(docs, ["a", "b"], np.ones((2, language.DIM), np.float32) / np.sqrt(language.DIM))
    assert {r.lang_pred for r in tied.collect()} == {"a"}


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, parts_ string, formatted string, loss string"
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], schema))).count() == 0
    long = "[INST]\\" * 50_000
    rows = [(1, 0, "user", long, "c", "c", "c"), (1, 1, "assistant", long, "c", "c", "c"), (None, 0, "user", None, "c", "c", "c"), (2, 0, "assistant", "x", "c", "c", "c"), (2, 0, "assistant", "x", "c", "c", "c")]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(spark.createDataFrame(rows, schema))).collect()}
    assert got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest() and got[1].loss_chars == len(long)
    assert got[2].n_turns == 2 and got[2].loss_chars == 2 and got[None].n_turns == 1
    flat = chat.Flatten("assistant")
    for part in ({"type": "document", "ref": "d", "pages": 3}, {"type": "text", "text": "<|document|>"}, {"text": None}):
        flat.visit(part)
    text = flat.close()
    assert text == "[ROLE]assistant[/ROLE]<|document|><\\|document|></s>" and flat.attachments == [{"at": 22, "type": "document", "ref": "d", "tokens": 1536}]
    assert chat.unescape("".join(text[s["start"] : s["end"]] for s in flat.loss)) == "<|document|>"
    with pytest.raises(ValueError):
        flat.visit({"type": "video"})


def test_scratch_deletes_what_its_own_thread_wrote(spark):
    from concurrent.futures import ThreadPoolExecutor

    from ability_engine.llm import common

    def other():
        with common.scratch(spark):
            return common.stash(spark.range(4), "other")

    with ThreadPoolExecutor(1) as pool, common.scratch(spark):
        mine = common.stash(spark.range(3), "mine")
        theirs = pool.submit(other).result()
        assert mine.count() == 3
        files = mine.inputFiles() + theirs.inputFiles()
        with common.scratch(spark):
            inner = common.stash(spark.range(2), "inner").inputFiles()
            assert all(common.exists(spark, f) for f in inner)
        assert not any(common.exists(spark, f) for f in inner) and mine.count() == 3
    assert files and not any(common.exists(spark, f) for f in files)

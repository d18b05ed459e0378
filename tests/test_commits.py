"""Publication in versions: what fails leaves the last one, files and log together; and the merge of a run by a plain walk."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ability_engine.operators import merge
from ability_engine.sources import commits, star


def files(spark, tmp_path, name, ids):
    folder = tmp_path / name
    folder.mkdir()
    for lab in sorted({i[0] for i in ids}):
        releases = [{"id": i, "lab": lab, "name": i, "date": "2024-01-01", "date_precision": "day", "status": "released"} for i in ids if i[0] == lab]
        (folder / f"{lab}.json").write_text(json.dumps({"lab": lab, "updated_at": "u", "releases": releases}))
    return star.lab_files(spark, str(folder))


def events(spark, *ids):
    return spark.createDataFrame([("2024", "t", i[0], i, "release_added", i, None) for i in ids], star.CHANGE)


def state(spark, folder):
    return commits.version(spark, folder), sorted(r.id for r in star.releases(commits.lab_files(spark, folder)).collect()), sorted(r.release_id for r in commits.changes(spark, folder).collect())


def test_commit_is_all_or_nothing(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "data")
    assert state(spark, folder) == (0, [], [])
    one, two = files(spark, tmp_path, "one", ["a-1", "b-1"]), files(spark, tmp_path, "two", ["a-1", "a-2", "b-1"])
    assert commits.commit(one, events(spark, "a-1", "b-1"), folder).written
    first = state(spark, folder)
    assert first == (1, ["a-1", "b-1"], ["a-1", "b-1"])
    # It fails at each step in turn.
    for owner, step in ((star, "canonical"), (star, "append_changes"), (commits, "_point")):
        with monkeypatch.context() as m:
            m.setattr(owner, step, lambda *a, **k: (_ for _ in ()).throw(OSError("cut off")))
            with pytest.raises(OSError):
                commits.commit(two, events(spark, "a-2"), folder)
        assert state(spark, folder) == first
    # Bad changes and bad files.
    with pytest.raises(Exception, match="a change needs"):
        commits.commit(two, events(spark, "a-2").withColumn("kind", F.lit(None).cast("string")), folder)
    bad = lambda staged: star.releases(staged).where("id = 'a-2'").select(F.lit("error").alias("severity"), F.concat(F.lit("bad "), "id").alias("message"))
    out = commits.commit(two, events(spark, "a-2"), folder, check=bad)
    assert not out.written and out.errors == ["bad a-2"] and state(spark, folder) == first
    # A manifest that is cut off while it is written doesn't count, and its number is left out.
    (tmp_path / "data" / "manifest" / "0000000002").write_text('{"models": "x')
    assert state(spark, folder) == first
    done = commits.commit(two, events(spark, "a-2"), folder, check=lambda staged: bad(staged).limit(0))
    assert done == commits.Outcome(3, True) and state(spark, folder) == (3, ["a-1", "a-2", "b-1"], ["a-1", "a-2", "b-1"])
    assert commits.audit(commits.lab_files(spark, folder), commits.changes(spark, folder)).count() == 0
    # Nothing to do, a stale base, and another commit that came first.
    assert commits.commit(two, events(spark, "a-2"), folder) == commits.Outcome(3, False) == commits.commit(one, events(spark), folder)
    assert commits.commit(one, events(spark, "z"), folder, base=1).errors
    with monkeypatch.context() as m:
        m.setattr(commits, "_next", lambda *a: 3)
        lost = commits.commit(one, events(spark, "z"), folder)
        assert not lost.written and "meanwhile" in lost.errors[0] and state(spark, folder)[0] == 3
    # An old version again; the log stays whole, and what nobody names goes.
    assert commits.restore(spark, folder, 1) == commits.Outcome(4, True)
    assert state(spark, folder) == (4, ["a-1", "b-1"], ["a-1", "a-2", "b-1"]) and commits.lab_files(spark, folder, 3).count() == 2
    gone = commits.sweep(spark, folder, keep=1)
    assert gone and state(spark, folder) == (4, ["a-1", "b-1"], ["a-1", "a-2", "b-1"])


RANK = {"cancelled": -1, "rumored": 1, "announced": 2, "released": 3}


def walk(published, scores, sources, incoming, found):
    """Row after row, as the contract of the merge says."""
    releases = {r["id"]: dict(r) for r in published}
    held = {(s["release_id"], s["benchmark"], s["config"] or "") for s in scores}
    urls = {}
    for s in sources:
        urls.setdefault(s["release_id"], []).append(s["url"])
    log, precision = [], {"unknown": 0, "year": 1, "quarter": 2, "month": 3, "day": 4}
    for row in sorted(incoming, key=lambda r: r["pos"]):
        mine = [f for f in sorted(found, key=lambda f: f["score_pos"]) if f["pos"] == row["pos"]]
        target = next((r for r in releases.values() if r["name"] == row["name"]), None)
        touched = created = target is None
        if created:
            target = {k: row[k] for k in ("name", "status", "date", "date_precision", "tier")} | {"id": "l-" + row["name"].lower()}
            releases[target["id"]] = target
            log.append((target["id"], row["pos"], "release_added"))
        for f in mine:
            key = (target["id"], f["benchmark"], f["config"] or "")
            if key not in held:
                held.add(key)
                touched = True
                if not created:
                    log.append((target["id"], row["pos"], "score_added"))
        if not created:
            finer = precision[row["date_precision"]] > precision[target["date_precision"]]
            best = row["date_precision"] if finer else target["date_precision"]
            if "cancelled" not in (target["status"], row["status"]) and RANK[row["status"]] > RANK[target["status"]] and not (row["status"] == "released" and best == "unknown"):
                target["status"], touched = row["status"], True
                log.append((target["id"], row["pos"], "status_changed"))
            if finer:
                target["date"], target["date_precision"], touched = row["date"], best, True
                log.append((target["id"], row["pos"], "release_updated"))
        if touched and row["url"] and row["url"] not in urls.setdefault(target["id"], []):
            urls[target["id"]].append(row["url"])
        if not created and not target["tier"] and row["tier"] in ("mid", "small"):
            target["tier"] = row["tier"]
            log.append((target["id"], row["pos"], "release_updated"))
    return releases, held, urls, log


@pytest.mark.parametrize("seed", range(2))
def test_merge_of_a_run_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    names = [f"N{k}" for k in range(8)]
    make = lambda n: {"name": n, "status": rng.choice(list(RANK)), "date": f"2024-0{rng.randrange(1, 9)}-01", "date_precision": rng.choice(["unknown", "year", "month", "day"]), "tier": rng.choice([None, "flagship", "mid"])}
    published = [{"lab": "l", "id": "l-" + n.lower(), **make(n)} for n in names[:5]]
    scores = [{"release_id": r["id"], "benchmark": b, "config": None, "value": 1.0} for r in published for b in "ab" if rng.random() < 0.5]
    sources = [{"release_id": r["id"], "pos": 0, "url": "u0"} for r in published if rng.random() < 0.7]
    incoming = [{"lab": "l", "pos": p, "url": rng.choice(["u0", "u1", "u2", None]), **make(rng.choice(names))} for p in range(30)]
    found = [{"lab": "l", "pos": p, "score_pos": k, "benchmark": rng.choice("abc"), "config": rng.choice([None, "x"]), "value": 50.0} for p in range(30) for k in range(rng.randrange(3))]
    row = "lab string, {}name string, status string, date string, date_precision string, tier string"
    table = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    after, all_scores, all_sources, changes = merge.merge_run(
        table(published, row.format("id string, ")), table(scores, "release_id string, benchmark string, config string, value double"), table(sources, "release_id string, pos int, url string"),
        table(incoming, row.format("pos int, ") + ", url string"), table(found, "lab string, pos int, score_pos int, benchmark string, config string, value double"),
    )
    releases, held, urls, log = walk(published, scores, sources, incoming, found)
    assert {r.id: (r.status, r.date, r.date_precision, r.tier) for r in after.collect()} == {k: (r["status"], r["date"], r["date_precision"], r["tier"]) for k, r in releases.items()}
    got = [(r.release_id, r.benchmark, r.config) for r in all_scores.collect()]
    assert len(got) == len(set(got)) and set(got) == held
    ordered = {}
    for r in sorted(all_sources.collect(), key=lambda r: (r.release_id, r.pos)):
        ordered.setdefault(r.release_id, []).append(r.url)
    assert ordered == {k: v for k, v in urls.items() if v}
    assert sorted((r.id, r.pos, r.kind) for r in changes.collect()) == sorted(log)

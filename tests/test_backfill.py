"""The backfill's queue against a walk entry by entry."""

import random
import re

import pytest

from ability_engine.operators import backfill

LABS, NAMES = ("a", "b"), ("Nova 1", "Nova 2", "Nova 1 Pro", "Nova 3")


def key(text):
    return re.sub(r"[^a-z0-9.]+", "", text.lower())


def score(url, name):
    low = re.sub("^https://[^/]+", "", url)
    flat, parts = re.sub("[^a-z0-9]", "", low), [p for p in re.split("[^a-z0-9]+", low) if p]
    words = name.lower().split()
    return 2 if key(name) in flat else int(all(w in parts for w in words if w.isdigit()) and any(w in flat for w in words if not w.isdigit()))


def by_hand(t, budget):
    visits, releases, spent = [], [], 0
    for lab in LABS:
        queue = [dict(zip(("lab", "_", "name", "url"), c[:4], strict=True), depth=0, retried=False) for c in t["candidates"] if c[0] == lab]
        seen, landed = {q["url"].rstrip("/") for q in queue}, {key(n) for own, n in t["known"] if own == lab}
        at = 0
        while at < len(queue):
            q = queue[at]
            at += 1

            def grow(url, retried, q=q, seen=seen, queue=queue):
                if url.rstrip("/") in seen:
                    return False
                seen.add(url.rstrip("/"))
                queue.append({**q, "url": url, "depth": q["depth"] + 1, "retried": retried})
                return True

            status = None
            if spent >= budget:
                status = "stopped"
            elif key(q["name"]) in landed:
                status = "skipped"
            elif q["url"] not in t["pages"]:
                status = "unreadable"
            elif re.sub("^https://[^/]+", "", q["url"]) in ("", "/"):
                found = sorted((-score(link, q["name"]), n, link) for page, n, link in t["links"] if page == q["url"] and score(link, q["name"]))[:3]
                status = "expanded" if sum([grow(link, q["retried"]) for _, _, link in found]) else "no link"
            else:
                spent += 1
                answers = [r for r in t["answers"] if r[0] == q["url"]]
                kept = [r[2] for r in answers if r[3] is None and r[2].lower() in q["name"].lower()]
                status = "extracted" if kept else "nothing"
                for name in kept:
                    if key(name) not in landed:
                        landed.add(key(name))
                        releases.append((lab, name, q["url"]))
                if not kept and not q["retried"] and any(r[3] == "no usable date" for r in answers):
                    posts = [link for own, _, title, link, _ in t["news"] if own == lab and re.search(re.escape(key(q["name"])) + "(?![0-9.])", key(title)) and link != q["url"]]
                    if posts and grow(posts[0], True):
                        status = "retry"
            visits.append((lab, at, q["name"], q["url"], q["depth"], status))
    return sorted(visits), sorted(releases)


def tables(rng):
    urls = {lab: [f"https://{lab}.example/news/{n.lower().replace(' ', '-')}{x}" for n in NAMES for x in ("", "/late", "/x")] for lab in LABS}
    homes = {lab: [f"https://{lab}.example", f"https://{lab}{lab}.example/"] for lab in LABS}
    t = {"candidates": [(lab, p, rng.choice(NAMES), rng.choice(urls[lab] + homes[lab] * 3), None, True) for lab in LABS for p in range(rng.randint(0, 9))]}
    every = [u for lab in LABS for u in urls[lab] + homes[lab]]
    t["pages"] = {u for u in every if rng.random() < 0.85}
    t["links"] = [(home, n, link) for lab in LABS for home in homes[lab] for n, link in enumerate(rng.sample(urls[lab], 7))]
    t["answers"] = [(u, n, rng.choice(NAMES), rng.choice([None, "no usable date", "no usable date", "empty name"])) for lab in LABS for u in urls[lab] for n in range(rng.randint(0, 2))]
    t["news"] = [(lab, p, f"Introducing {rng.choice(NAMES)}", u, None) for lab in LABS for p, u in enumerate(rng.sample(urls[lab] + homes[lab], 8))]
    t["known"] = [(lab, rng.choice(NAMES)) for lab in LABS if rng.random() < 0.3]
    return t


def walked(spark, t, budget):
    df = spark.createDataFrame
    visits, releases = backfill.walk(
        df(t["candidates"], "lab string, pos long, name string, url string, date string, official boolean"), df([(u,) for u in t["pages"]], "url string"), df(t["links"], "url string, n long, link string"),
        df(t["answers"], "url string, answer_pos long, release string, reason string"), df(t["news"], "lab string, pos long, title string, link string, date string"),
        df([(lab, f"{lab}.example") for lab in LABS], "lab string, host string"), df(t["known"], "lab string, name string"), budget,
    )
    return sorted((r.lab, r.pos, r.name, r.url, r.depth, r.status) for r in visits.collect()), sorted((r.lab, r.release, r.url) for r in releases.collect())


@pytest.mark.parametrize(("seed", "budget"), [(1, 100), (2, 5), (3, 100)])
def test_queue_equals_a_walk(spark, seed, budget):
    t = tables(random.Random(seed))
    want = by_hand(t, budget)
    assert walked(spark, t, budget) == want
    assert len({v[4] for v in want[0]}) > 1


def test_nulls_and_nothing(spark):
    none = {"candidates": [], "pages": set(), "links": [], "answers": [], "news": [], "known": []}
    assert walked(spark, none, 5) == ([], [])
    odd = none | {"candidates": [("a", 1, None, None, None, None), ("a", 2, "Nova", None, None, True)]}
    assert walked(spark, odd, 5) == ([("a", 1, None, None, 0, "unreadable"), ("a", 2, "Nova", None, 0, "unreadable")], [])

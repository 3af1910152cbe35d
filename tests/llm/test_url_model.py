"""URL verdicts against a plain recount: word counts, every split of a run, naive Bayes in a loop."""

import math
import random
import re
import time
from collections import Counter

import pytest
from test_pages import parts, rule_of

from orrery.llm import url_filter


def cheapest(run, cost, total):
    """Every split of a run, by brute force."""
    unknown = lambda n: math.log(total) - math.log(10) + n * math.log(10)
    best = (math.inf, [])
    for cuts in range(1 << max(0, len(run) - 1)):
        words, begin = [], 0
        for i in range(1, len(run) + 1):
            if i == len(run) or cuts >> (i - 1) & 1:
                words.append(run[begin:i])
                begin = i
        best = min(best, (sum(cost.get(w, unknown(len(w))) for w in words), words), key=lambda x: x[0])
    return best


def price(words, cost, total):
    return sum(cost.get(w, math.log(total) - math.log(10) + len(w) * math.log(10)) for w in words)


def test_segment_finds_the_cheapest_split():
    rng = random.Random(3)
    for _ in range(200):
        run = "".join(rng.choice("abc") for _ in range(rng.randint(1, 11)))
        words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(8)}
        total = 10.0 ** rng.randint(1, 6)
        cost = {w: math.log(total) - math.log(rng.randint(1, int(total))) for w in words}
        found = url_filter.segment(run, cost, total)
        assert "".join(found) == run and math.isclose(price(found, cost, total), cheapest(run, cost, total)[0], abs_tol=1e-9)


def plain_verdicts(rows):
    """page_id -> log odds, by loops over pages."""
    runs = lambda t: re.findall("[a-z]+", t)
    lower = str.lower
    pages = {}
    for i, url, html in rows:
        host, path = parts(url)
        best = rule_of(host, path)
        pages[i] = (host, re.sub("[0-9]+", "0", path), best[1] if best else None)
    counts = Counter(w for _, _, html in rows for t in re.findall(r"(?is)<title[^>]*>(.*?)</title", html or "")[:1] for w in runs(lower(t)))
    for key in [*{p[0] for p in pages.values()}, *{p[1] for p in pages.values()}]:
        for label in re.split("[./]", lower(key)):
            if re.search("[a-z][0-9]*[-_+,~][-_+,~0-9]*[a-z]", label):
                counts.update(runs(label))
    total = sum(counts.values()) or 1
    cost = {w: math.log(total) - math.log(n) for w, n in counts.items()}

    def tokens(key, mark):
        words = [w for r in runs(lower(key)) for w in url_filter.segment(r, {w: c for w, c in cost.items() if w in r}, total)]
        return [mark + w for w in words] + [mark + "#"] * len(re.findall("[0-9]+", key))

    seen = {"block": Counter(), "allow": Counter()}
    vocabulary, n_pages = set(), Counter()
    for host, path, verdict in pages.values():
        own = tokens(host, "h:") + tokens(path, "p:")
        vocabulary |= set(own)
        if verdict:
            seen[verdict].update(own)
            n_pages[verdict] += 1
    size = len(vocabulary)
    weight = lambda t: math.log((seen["block"][t] + 1) / (sum(seen["block"].values()) + size + 1)) - math.log((seen["allow"][t] + 1) / (sum(seen["allow"].values()) + size + 1))
    prior = math.log(n_pages["block"] + 1) - math.log(n_pages["allow"] + 1)
    return {i: prior + sum(map(weight, tokens(h, "h:") + tokens(p, "p:"))) for i, (h, p, _) in pages.items()}


@pytest.mark.parametrize("seed", [0, 1])
def test_scores_equal_a_plain_recount(spark, seed):
    rng = random.Random(seed)
    words = ["cheap", "pills", "news", "garden", "tools", "a", "on", "line", "online", "x" * 40]
    rows = []
    for i in range(150):
        name = "".join(rng.sample(words, rng.randint(1, 3))) if i % 3 else "-".join(rng.sample(words, 2))
        rest = rng.choice([f".com/en/{i}", f".net/de/{i}", ".org/es/x", f".org/fr/{rng.choice(words)}{i}", f"{i}.example.com/en/7{i}", ".io"])
        rows.append((i, f"http://{name}{rest}", rng.choice([None, f"<title>{' '.join(rng.sample(words, 3))}</title>"])))
    rows += [(900, None, None), (901, "", "<title></title>"), (902, rows[0][1], None)]
    found = {r.page_id: r for r in url_filter.verdicts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = plain_verdicts(rows)
    for i, score in want.items():
        assert math.isclose(found[i].block_score, score, rel_tol=1e-9, abs_tol=1e-9)
        if found[i].rule is None:
            assert found[i].verdict == ("block" if score > 0 else "allow")


def test_runs_of_a_million_letters(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghij") for _ in range(1_000_000))
    rows = [(1, "http://a.net/" + long, None), (2, "http://b.net/" + "a" * 1_000_000 + "/x", "<title>aa aaa " + "a" * 100 + " abc</title>"), (3, "http://abc.com/en/", None)]
    began = time.time()
    found = url_filter.verdicts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert len(found) == 3 and time.time() - began < 90

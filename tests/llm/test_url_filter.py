import random

from foliograph.llm import url_filter as u
from pyspark.sql import functions as F

RULES = (u.Rule("allow", "com", "/"), u.Rule("block", "example.com", "/en/"), u.Rule("allow", "www.example.com", "/en/"), u.Rule("block", "net", "/es/"))


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best


URLS = [None, "", "no scheme", "http://", "http://A.Example.COM/en/x?y#z", "http://www.example.com/en/", "https://example.com", "ftp://x.net/es/?a=b", "http://net/es/a", "http://xnet/es/", "http://x.org?u=http://a.com/", "a://b://c.com/d", "http://É.com/ü", "http://notexample.com/en/1"]


def test_rules(spark):
    rows = [(i, x, "h", "p", 1.0) for i, x in enumerate([*URLS, *URLS[:3]])]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, length double")
    got = {r.page_id: r for r in u.judge(pages, RULES).collect()}
    assert len(got) == len(rows)
    for i, x, *_ in rows:
        host, path, rule = brute(x)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.name)
        assert got[i].verdict == rule.verdict if rule else got[i].verdict in ("allow", "block")


def test_degenerate(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (None, None)], "page_id long, url string")
    assert {r.verdict for r in u.judge(pages, RULES).collect()} == {"allow"}  # nothing labelled
    assert {r.verdict for r in u.judge(pages, (u.Rule("block", "org", "/"),)).collect()} == {"block"}  # one kind of label
    assert u.judge(pages.where("false"), RULES).count() == 0
    assert u.judge(pages, ()).count() == 2


def test_held_out_accuracy(spark):
    """Spam urls have long digit-laden paths; half of either kind is labelled by a rule on the host."""
    rng = random.Random(3)
    rows, truth = [], {}
    for i in range(800):
        spam, host = i % 2, ("a.bad.com", "b.good.com", "free.org")[rng.randrange(3)]
        if host != "free.org":
            host = "a.bad.com" if spam else "b.good.com"
        path = "".join(rng.choice("0123456789") for _ in range(30)) + "?" + "&".join("q=1" for _ in range(6)) if spam else "/".join(rng.choice(("news", "about", "team")) for _ in range(2))
        rows.append((i, f"http://{host}/{path}"))
        truth[i] = "block" if spam else "allow"
    got = u.judge(spark.createDataFrame(rows, "page_id long, url string"), (u.Rule("block", "bad.com", "/"), u.Rule("allow", "good.com", "/"))).collect()
    open_ = [r for r in got if r.rule is None]
    assert len(open_) > 200 and sum(r.verdict == truth[r.page_id] for r in open_) / len(open_) > 0.95
    assert all(0 <= r.score <= 1 for r in open_)


def test_rates_cover_all_labelled_urls(spark, monkeypatch):
    """Segments tell spam, and there are more of them than the trees' sample has urls."""
    monkeypatch.setattr(u, "SAMPLE", 100)
    rng = random.Random(5)
    names = ["".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(300)]
    rows, truth = [], {}
    for i in range(3600):
        k = i % 300
        host = "adb.com" if i >= 3300 else "bad.com" if k % 2 else "dab.com"  # alike but for the segment
        rows.append((i, f"http://{host}/{names[k]}/x"))
        truth[i] = "block" if k % 2 else "allow"
    got = u.judge(spark.createDataFrame(rows, "page_id long, url string"), (u.Rule("block", "bad.com", "/"), u.Rule("allow", "dab.com", "/"))).collect()
    open_ = [r for r in got if r.rule is None]
    assert len(got) == len(rows) and len(open_) == 300
    assert sum(r.verdict == truth[r.page_id] for r in open_) / len(open_) > 0.95


def test_rates_of_the_training_urls_lack_their_own_label(spark):
    rows = [(i, f"http://{'bad' if i % 2 else 'dab'}.com/s{i}/x") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": u.host_of(F.col("url")), "path": u.path_of(F.col("url"))})
    pages = pages.withColumn("given", F.when(F.col("host") == "bad.com", "block").otherwise("allow"))
    held, _, count, blocked = u._rates(pages)
    sample = u.with_features(pages).withColumn("label", (F.col("given") == "block").cast("double"))
    got = u._out_of_fold(sample, held, blocked / count).collect()
    assert len(got) == 60 and {r.segment_rate for r in got} == {0.5}  # each segment is one url's
    assert all(0 < r.domain_rate < 1 for r in got)

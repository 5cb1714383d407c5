"""URL filter: digest array, collisions, edge cases."""

import numpy as np
from plaintide.llm import urls


def judged(spark, rows, rules=urls.RULES):
    pages = spark.createDataFrame(rows, "url string, host int")
    table = spark.createDataFrame(list(rules), "host string, path string, verdict string")
    return {r.url: tuple(r.judged) for r in urls.filtered(pages, table).collect()}


def test_rules_and_edge_cases(spark):
    rows = [
        ("http://A.Example.NET/en/1?x#y", 1), ("https://example.net/fr/2", 2), ("http://net", 3), ("http://xnet/", 4),
        ("http://x.example.com/de/", 5), ("http://x.org/fr/a", 6), ("no scheme", 7), (None, 8), ("", 9),
        ("http://a.net?u=://b.org/fr/", 10), ("x\n://q.net/\n", 11), ("http://" + "a." * 5000 + "net/" + "p" * 50_000, 12),
    ]
    got = judged(spark, rows)
    assert got["http://A.Example.NET/en/1?x#y"] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got["https://example.net/fr/2"] == ("example.net", "/fr/2", "net/", "block")
    assert got["http://net"] == ("net", "", None, "allow")
    assert got["http://xnet/"] == ("xnet", "/", None, "allow")
    assert got["http://x.example.com/de/"][2:] == ("example.com/de/", "block")
    assert got["http://x.org/fr/a"][2:] == ("org/fr/", "allow")
    assert got["no scheme"] == got[None] == got[""] == ("", "", None, "allow")
    assert got["http://a.net?u=://b.org/fr/"] == ("a.net", "", None, "allow")
    assert got["x\n://q.net/\n"] == ("q.net", "/\n", "net/", "block")
    assert got[rows[-1][0]][2:] == ("net/", "block")


def test_many_rules_agree_with_a_scan(spark, tmp_path, monkeypatch):
    """Digests of eight values only: nearly every probe collides and is settled by its string."""
    monkeypatch.setattr(urls, "_digest", lambda key: len(key) % 8)
    rng = np.random.default_rng(3)
    names = ["a", "b", "a.b", "b.a", "c.a.b", "b.b.a"]
    rules = {(names[rng.integers(6)], "/" + "xy"[: rng.integers(3)]): ["allow", "block"][rng.integers(2)] for _ in range(30)}
    listed = sorted((urls._digest(f"{h}\n{p}"), h, p, v) for (h, p), v in rules.items())
    files, firsts = [], []
    for k, part in enumerate(([r for r in listed if r[0] < 3], [r for r in listed if 3 <= r[0] < 5], [r for r in listed if r[0] >= 5])):
        file = tmp_path / f"rules{k}.bin"
        file.write_bytes(urls.pack(np.array([r[0] for r in part], np.uint64), [r[1:] for r in part]))
        files.append(urls.DigestFile(str(file)))
        firsts.append(part[0][0])
    hosts = [".".join(np.array(["a", "b", "c"])[rng.integers(0, 3, rng.integers(1, 5))]) for _ in range(300)]
    paths = ["/" + "xyz"[: rng.integers(4)] for _ in hosts]
    expected = []
    for host, path in zip(hosts, paths):
        fit = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        expected.append(max(fit)[2:] if fit else (None, None))
    assert urls.DigestArray(files, firsts, 4, [1, 2, 3]).judge(hosts, paths) == expected


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert urls.filtered(pages, rules).count() == 0
    one = spark.createDataFrame([("http://a.net/",)], "url string")
    assert urls.filtered(one, rules).first().judged.verdict == "allow"


def test_rules_in_many_files(spark):
    """Rules are written by several tasks, repeated and damaged ones among them."""
    rules = [(f"h{i}.net", "/" + "p" * (i % 4), "block" if i % 3 else "allow") for i in range(500)]
    rules += [("h3.net", "/ppp", "block"), (None, "/", "block"), ("h4.net", None, "block"), ("h5.net", "/p", None)]
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    names, firsts, labels, lengths = urls.publish(spark, table, part=64)
    assert len(names) >= 6 and firsts == sorted(firsts) and (labels, lengths) == (2, [1, 2, 3, 4])
    held = [urls.DigestFile(urls.SparkFiles.get(n)) for n in names]
    assert sum(len(f.digests) for f in held) == 500
    array = urls.DigestArray(held, firsts, labels, lengths)
    hosts = [f"x.h{i}.net" for i in range(510)]
    got = array.judge(hosts, ["/pppp/x"] * 510)
    for i, (rule, verdict) in enumerate(got):
        assert (rule, verdict) == ((f"h{i}.net/" + "p" * (i % 4), "block" if i % 3 or i == 3 else "allow") if i < 500 else (None, None))

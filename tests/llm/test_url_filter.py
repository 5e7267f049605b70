import random

from quernstone.llm import url_filter as U


def slow(host, path, rules):
    fits = []
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(h), len(slash + p), verdict == "block", rule, verdict))
    return max(fits)[3:] if fits else None


def test_trie_against_brute_force():
    rng = random.Random(5)
    labels, segments = ["a", "b", "net", "x-y"], ["", "en", "e", "de", "en2"]
    rules = [(rng.choice(["allow", "block"]), ".".join(rng.choices(labels, k=rng.randint(1, 3))) + "/" + "/".join(rng.choices(segments, k=rng.randint(0, 3)))) for _ in range(60)]
    trie = U.Trie(rules)
    for _ in range(3000):
        host, path = ".".join(rng.choices([*labels, ""], k=rng.randint(1, 4))), rng.choice(["", "/"]) + "/".join(rng.choices(segments, k=rng.randint(0, 4)))
        assert trie.find(host, path) == slow(host, path, rules), (host, path)


def test_edge_cases_and_the_join(spark):
    urls = [None, "", "no scheme", "http://", "HTTPS://A.Example.NET/en/x?y#z", "http://example.net", "http://net/", "ftp://q.net?x=/en/", "http://a.org/fr/", "http://a.org/FR/", "x://é.net/è", "http://notexample.com/de/", "http://example.com/de/a://b"]
    rows = [(i, u, 1) for i, u in enumerate(urls)] + [(0, None, 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, host int")
    got = sorted(map(tuple, U.judge(df, U.RULES).collect()), key=str)
    assert got == sorted(map(tuple, U.judge(df, U.RULES, max_broadcast_chars=0).collect()), key=str)
    by_id = {r[0]: r[1:] for r in got}
    assert by_id[0] == by_id[2] == ("", "", None, "allow")
    assert by_id[4] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by_id[5] == ("example.net", "", None, "allow") and by_id[6][2:] == ("net/", "block")
    assert by_id[8][2:] == ("org/fr/", "allow") and by_id[9][2:] == (None, "allow") and by_id[11][2] is None
    assert U.judge(df.limit(0), U.RULES).count() == 0

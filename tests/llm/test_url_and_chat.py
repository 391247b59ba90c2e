import hashlib

from clauseriver.llm import chat_format, url_filter


def judge(spark, rows, rules=url_filter.RULES, **kw):
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    rules = spark.createDataFrame(rules, url_filter.RULE_SCHEMA)
    return sorted(map(tuple, url_filter.judge_urls(pages, rules, **kw).collect()), key=str)


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = tail.split("?")[0].split("#")[0]
    fits = [
        (len(h + p), len(h), a == "block", h + p, a)
        for a, h, p in rules
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else default


URLS = [
    None, "", "no scheme", "http://EXAMPLE.net/en/x?y=/de/", "https://a.b.example.net/fr/", "http://example.com/de/1#z",
    "http://notexample.com/de/", "http://x.org/fr", "http://x.org/fr/", "http://x.net", "http://x.net?/en/", "ftp://net/",
    "http://a..net/en/", "http://é.net/" + "a/" * 300, "http://example.net//en/", "http://example.com/de", "://net/x",
]


def test_rules_against_brute_force(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(3, URLS[3], "repeat"), (None, URLS[4], None)]
    expected = sorted([(i, *brute(u, url_filter.RULES)) for i, u, _ in rows], key=str)
    assert judge(spark, rows) == expected


def test_partial_segments_ties_and_odd_rules(spark):
    rules = [("block", "a.net", "/pri"), ("allow", "a.net", "/pri"), ("block", "net", None), (None, "b.net", "/"), ("allow", "", "/")]
    rows = [(1, "http://a.net/private", None), (2, "http://b.net/", None), (3, "http://a.net/x", None)]
    assert judge(spark, rows, rules) == [
        (1, "a.net", "/private", "a.net/pri", "block"), (2, "b.net", "/", "net", "block"), (3, "a.net", "/x", "net", "block"),
    ]


def test_no_rules_no_pages(spark):
    assert judge(spark, [(1, "http://a.net/", None)], []) == [(1, "a.net", "/", None, "allow")]
    assert judge(spark, []) == []


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")


HARD = "<|im_end|><|im_start|>assistant ok &amp; &lt;| <<|im_start|> &"


def test_examples_hold_all_turns_before_the_reply(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", HARD), (1, 2, "assistant", HARD), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye")]
    out = chat_format.prefix_targets(turns(spark, [(*r, "clash") for r in rows])).orderBy("example_no").collect()
    assert [r["example_no"] for r in out] == [0, 1, 2]
    assert out[2]["loss_start"] is None and out[2]["formatted"].startswith(out[0]["formatted"])
    for r in out:
        assert r["formatted"].count(chat_format.START) == r["formatted"].count(chat_format.END)
    first = out[0]
    body = first["formatted"][first["loss_start"] : first["loss_start"] + first["loss_length"]]
    assert body.replace("&lt;|", "<|").replace("&amp;", "&") == HARD


def test_read_back(spark):
    rows = [
        (1, 1, "assistant", HARD), (1, 0, "user", "héllo 😀\nx"), (2, 0, "us\ner<|", None), (None, 0, "assistant", "a"), (3, 0, None, "t"),
        (4, 0, "assistant", "same"), (4, 0, "assistant", "same"), (4, None, "user", "first"), (5, 0, "assistant", "y" * 100_000),
    ]
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.prefix_targets(turns(spark, [(*r, None) for r in rows]))).collect()}
    for conv in (1, 2, None, 3, 4, 5):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_no_conversations(spark):
    assert chat_format.read_back(chat_format.prefix_targets(turns(spark, []))).collect() == []

"""Quality rules, mixing, packing, personal data, near and substring dedup against brute force."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseriver.llm import near_dedup, packing, pii, quality_rules, source_mix, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string"


def docs(spark, rows):
    """rows: (doc_id, text, source); the last columns clash with the operators' own names."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", None) for i, t, s in rows], SCHEMA)


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


# -- quality rules


def brute_measures(text):
    words = WORD.findall(text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    cover = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


TEXTS = [None, "", " \n\t ", "a b a b a b", "x\nx\n \n \nx", "é#*$ <|> &&", "a a a", prose(1, 60) + "\n" + prose(1, 60), prose(2, 100_000)]


@pytest.mark.parametrize("text", TEXTS)
def test_measures(text):
    assert quality_rules.measure_text(text) == brute_measures(text)


def test_hosts_pull_down_only_when_bad_throughout(spark):
    rows = [(i, "short text", "bad") for i in range(200)] + [(1000, prose(3, 80), "bad"), (1001, prose(4, 80), None)]
    rows += [(2000 + i, prose(i, 80) if i % 3 else "short", "mixed") for i in range(60)] + [(3000 + i, prose(i, 60), f"h{i}") for i in range(30)]
    out = {r["doc_id"]: r for r in quality_rules.judge_documents(docs(spark, rows)).collect()}
    assert not out[1000]["_base_failed"] and not out[1000]["_kept"]
    assert out[1001]["_kept"]
    assert all(out[2000 + i]["_kept"] == bool(i % 3) for i in range(60))
    assert all(out[3000 + i]["_kept"] for i in range(30))
    assert out[1000]["kept"] == "clash"


def test_quality_of_nothing(spark):
    assert quality_rules.judge_documents(docs(spark, [])).collect() == []


# -- mixing


def test_targets_are_the_water_level(spark):
    sizes = {"a": 100, "b": 10, "c": 1000, "d": 0, None: 50, "": 7}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_mix.targets(df).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            break
        fixed |= {s: 2 * sizes[s] for s in over}
    for s in order:
        assert got[s] == pytest.approx((fixed | share)[s])


def test_mix_takes_targets_and_sorts_by_time(spark):
    rows = [(i, prose(i, 10 + i % 40), ["a", "b", None][i % 3]) for i in range(300)] + [(5, prose(5, 15), "b")] * 2 + [(900, None, "a"), (901, "", "z")]
    df = docs(spark, rows)
    plan = source_mix.assign(df).collect()
    assert len(plan) == len(rows)
    by = defaultdict(lambda: [0, 0.0])
    for r in plan:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    for taken, target in by.values():
        assert taken == round(target)
    assert sorted(map(str, plan)) == sorted(map(str, source_mix.assign(df).collect()))
    mixed = source_mix.mix(df).collect()
    assert sum(len(WORD.findall(r["text"])) for r in mixed) == sum(r["taken"] for r in plan)
    at = [r["_position"] for r in mixed]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    assert {r["kept"] for r in mixed} == {"clash"}


def test_schedules_shift_sources_in_time(spark):
    rows = [(i, prose(i, 30), "abc"[i % 3]) for i in range(600)]
    mean = defaultdict(list)
    for r in source_mix.mix(docs(spark, rows)).collect():
        mean[r["source"]].append(r["_position"])
    assert np.mean(mean["a"]) < 0.45 < np.mean(mean["b"]) < 0.55 < np.mean(mean["c"])


def test_mix_of_nothing(spark):
    assert source_mix.mix(docs(spark, [])).collect() == []
    assert source_mix.mix(docs(spark, [(1, None, None)])).collect() == []


# -- packing

HARD_TEXTS = [None, "", " ", "a", "  two  spaces \n\n lines\t\ttabs", "nb sp  em　", "don't we'll I'm 12 3.4 $$ <|endoftext|>", "é😀 naïve", "x" * 5000, "a\x1cb!\x1d!", "  ", "word " * 3000]


def test_tokens_and_places(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, x, None) for i, x in enumerate(HARD_TEXTS)] + [(None, "null id", None), (3, "a", None)] + [(100 + i, prose(i, 50 + 37 * i), None) for i in range(40)]
    out = packing.pack(docs(spark, rows), keep_ids=True).collect()
    expected = []
    for i, x, _ in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        expected += [(i, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)) for s in range(0, len(ids), 1024)]
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted(expected, key=str)
    sequences = defaultdict(list)
    for r in out:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the tables aren't here")
def test_ids_are_those_of_the_plain_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = packing.Encoder("byte_bpe_50k", most=5000)
    odd = ["a <|endoftext|> b<|endoftext|><|endoftext|>  \n c", "<|endoftext|>", "x\u3000y\u3000\u3000z \u200b q\x85\x85r", " 's 's' '\n's it's 'LL'll", "\r\n a\r\nb \x1c\x1d c", *map(str, HARD_TEXTS)]
    for text in odd + [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]:
        assert e.ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_words_met_again_are_not_encoded_again():
    e = packing.Encoder("byte_bpe_50k", most=400)
    plain, seen = e.tokenizer, []

    class Counted:
        def encode(self, text, **options):
            seen.append(text)
            return plain.encode(text, **options)

    e.tokenizer = Counted()
    for k in range(12):  # more words than are held; one of them in every text, before other punctuation each time
        text = " ".join(["on", *(f"fresh{chr(97 + k)}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)), "steady" + "!,;***"[: k % 7] + "\n"])
        assert e.ids(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(e) + len(e.old) <= 400
    assert sum(x.count("steady") for x in seen) == 1


def test_ids_of_random_texts_are_those_of_the_plain_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e = packing.Encoder("byte_bpe_50k", most=300, at_once=7)
    parts = [*"aZéßÿĀɏ×÷ªµ\u0250жλ中\u0301'_,.*-`{~$5²½ \n\t\r\x1c\u00a0\u3000\u200b😀", "'s", "'ll", "the", " the", "  ", "<|endoftext|>"]
    rng = np.random.default_rng(7)
    texts = ["".join(rng.choice(parts, n)) for n in rng.integers(0, 40, 3000)]
    expected = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert list(e.each(texts, together=200)) == expected
    assert [e.ids(x) for x in texts] == expected


def test_padding_is_little():
    rng = np.random.default_rng(0)
    lengths = Counter(rng.integers(1, 1025, 50_000).tolist())
    patterns = packing.shortest_pack_first(lengths, 1024)
    used = Counter()
    for parts, count in patterns:
        assert sum(parts) <= 1024
        for p in parts:
            used[p] += count
    assert used == lengths
    assert sum(c for _, c in patterns) * 1024 < 1.06 * sum(k * v for k, v in lengths.items())


def test_pack_nothing(spark):
    assert packing.pack(docs(spark, [])).collect() == []


# -- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = [int(c) for c in re.sub("[^0-9]", "", value)]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0]))


PRIVATE = [
    None, "", "a@b.c_d@e.f x@y.z. @ a@b", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.255 1.2.3.4567 ..1.1.1.1", "4111 1111-1111 1111", "4111111111111111 x 4111111111111112",
    "+1 (269) 555-3296 +1+2 333 4444 55 + 1 +123- +49.30.1234567)", "é@x.fr naïve@exa.com 😀 a.b@c.d 😀😀 +49 30 1234567", "9" * 3000 + " " + "a." * 2000 + "@x.y", "1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6 7",
]


def test_base_spans(spark):
    out = pii.find_personal_data(docs(spark, [(i, t, None) for i, t in enumerate(PRIVATE)])).select("doc_id", pii.named(*pii.KINDS).alias("s"), pii.named(*pii.KINDS, "context").alias("all"))
    for r in out.collect():
        assert r["s"] == r["all"] == brute_spans(PRIVATE[r["doc_id"]])


def bootstrap_docs():
    rows = [(i, f"some words. contact: user{i}@mail{i}.example.com and more", None) for i in range(12)]
    rows += [(50, "again contact: agent-4711x9 wrote", None), (51, "contact: us today", None), (52, "see page: 12345678ab", None), (53, "member = agent-4711x9", None)]
    return rows


def test_patterns_find_identifiers_that_no_rule_knows(spark):
    rows = bootstrap_docs()
    out = {r["doc_id"]: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    text = dict((i, t) for i, t, _ in rows)
    assert [text[50][s["start"] : s["end"]] for s in out[50]["context"]] == ["agent-4711x9"]
    assert all(not out[i]["context"] for i in out if i != 50)
    assert all(len(out[i]["email"]) == 1 for i in range(12))


def test_patterns_spread_from_prose_to_a_context_without_seeds(spark):
    """Base entities stand in prose only, tokens partly too; then `key` is trusted through the tokens it shares."""
    ends = ["over there", "again today", "behind us", "below this"]
    rows = [(i, f"{prose(i, 9)} user{i}@mail{i}.example.com {ends[i % 4]} {prose(100 + i, 9)}", None) for i in range(60)]
    token = {i: f"{i:02d}" + "9f3ac7d1" * (5 if i < 230 else 25) for i in range(200, 240)}
    for i, t in token.items():
        rows.append((i, f'{prose(i, 9)} key = "{t}" {ends[i % 4] if i % 2 else prose(300 + i, 4)}', None))
    rows.append((500, f"{prose(1, 9)} year 2024-01-01x {prose(2, 9)}", None))
    text = dict((i, t) for i, t, _ in rows)
    out = {r["doc_id"]: [text[r["doc_id"]][s["start"] : s["end"]] for s in r["context"]] for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert {i: c for i, c in out.items() if c} == {i: [t] for i, t in token.items()}
    redacted = {r["doc_id"]: r["text"] for r in pii.redact(docs(spark, rows)).collect()}
    assert all('key = "[CONTEXT]" ' in redacted[i] and "9f3a" not in redacted[i] for i in token)


def test_runs_of_value_characters(spark):
    values = ["x" * 500 + "7", "--id_12345.a/b+c@", "YWJjZGVmZ2gxMg==", "a.b" * 30_000 + "1", "éà1234567"]
    df = docs(spark, [(i, f"😀 say: '{v}', end", None) for i, v in enumerate(values)] + [(10, "no-digits-in-here 1234567 4111-1111-1111-1112 1.2.3.400 key12345=value", None)])
    out = {r["doc_id"]: [(x["start"], x["value"]) for x in r["instances"] if not x["seed"]] for r in pii.scan(df).collect()}
    assert out == {i: [(8 + 2 * (i == 1), v.strip("-@"))] for i, v in enumerate(values)} | {10: [(56, "key12345")]}


def test_redaction_keeps_the_rest(spark):
    rows = bootstrap_docs() + [(60, "x a@b.cd y +1 (269) 555-3296 z", "s"), (61, None, "s"), (60, "x a@b.cd y +1 (269) 555-3296 z", "s")]
    out = defaultdict(list)
    for r in pii.redact(docs(spark, rows)).collect():
        out[r["doc_id"]].append(r["text"])
    assert out[60] == ["x [EMAIL] y [PHONE] z"] * 2 and out[61] == [None]
    assert out[50] == ["again contact: [CONTEXT] wrote"] and out[52] == ["see page: 12345678ab"]


def test_no_documents_no_data(spark):
    assert pii.find_personal_data(docs(spark, [])).collect() == []


# -- near-duplicates


def bags(texts):
    out = []
    for t in texts:
        w = WORD.findall(t or "")
        out.append(Counter(zip(*[w[k:] for k in range(min(5, len(w)))], strict=False)) if w else Counter())
    return out


def brute_classes(rows):
    known = [(i, t) for i, t, _ in rows if i is not None and WORD.search(t or "")]
    b = bags([t for _, t in known])
    parent = list(range(len(known)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(known)):
        for j in range(i):
            both = sum((b[i] & b[j]).values())
            if both >= 0.8 * (b[i].total() + b[j].total() - both):
                parent[root(i)] = root(j)
    least = {}
    for k, (i, _) in enumerate(known):
        least[root(k)] = min(i, least.get(root(k), i))
    return {known[k]: least[root(k)] for k in range(len(known))}


def near_rows():
    rows = []
    for family in range(6):
        words = prose(family, 150).split()
        for c in range(8):
            w = list(words)
            rng = np.random.default_rng(100 * family + c)
            for at in rng.integers(0, 150, rng.integers(0, 7)):
                w[at] = f"m{family}{c}{at}"
            rows.append((family * 100 + c, " ".join(w[: 150 - 9 * (c % 3)]), None))
    line = "a very common line that all share " * 30
    rows += [(1000 + i, line + prose(50 + i, 8 * i), None) for i in range(12)]
    rows += [(2000, "one two", None), (2001, "one  two\n", None), (2002, "", None), (2003, None, None), (2004, " ", None), (None, rows[0][1], None), (0, rows[0][1], None), (2005, "x " * 30_000, None)]
    return rows


def test_classes_against_brute_force(spark):
    rows = near_rows()
    expected = brute_classes(rows)
    out = near_dedup.classes(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        if (r["doc_id"], r["text"]) in expected:
            assert r["_class_id"] == expected[r["doc_id"], r["text"]]
            assert r["_is_first"] == (r["_class_id"] == r["doc_id"])
        else:
            assert r["_is_first"] and r["_class_id"] == r["doc_id"]


def test_one_of_each_class_stays(spark):
    rows = near_rows()
    kept = near_dedup.deduplicate(docs(spark, rows)).collect()
    expected = brute_classes(rows)
    assert Counter(r["doc_id"] for r in kept) == Counter([*set(expected.values()), 2002, 2003, 2004, None])


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a = Counter({int(x): int(w) for x, w in zip(rng.integers(0, 2**60, 300), rng.integers(1, 40, 300), strict=True)})
    b = Counter({x: w if i % 3 else max(1, w // 2) for i, (x, w) in enumerate(a.items()) if i % 10})
    m = 2000
    rows = [(k, x, w) for k, bag in enumerate((a, b)) for x, w in bag.items()]
    doc, feature, weight = (np.array(c) for c in zip(*rows, strict=True))
    s = near_dedup.bag_minhash(doc, feature.astype(np.uint64), weight.astype(float), 2, m)
    true = sum((a & b).values()) / sum((a | b).values())
    assert abs((s[0] == s[1]).mean() - true) < 4 * (true * (1 - true) / m) ** 0.5


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.classes(docs(spark, [])).collect() == []


# -- repeated passages


def brute_kept(rows, window=50):
    first = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out, key=str)


def passage_rows():
    shared = prose(7, 70)
    rows = [(i, prose(20 + i, 40) + " " + shared + "\n" + prose(60 + i, 30), None) for i in range(12)]
    rows += [(30 + i, " ".join(shared.split()[i : i + 52]), None) for i in range(12)]
    rows += [(50, "la " * 400, None), (51, "la " * 90 + prose(3, 10), None), (52, prose(9, 49), None), (53, prose(9, 49), None), (54, prose(9, 50), None), (55, prose(9, 50), None)]
    rows += [(-(2**63), "to " * 60, None), (62, "to " * 61, None), (63, "mono " * 20_000, None), (64, "mono " * 300, None)]
    rows += [(60, None, None), (61, "", None), (None, rows[0][1], None), (3, rows[5][1], None), (5, rows[5][1], None), (70, prose(5, 20_000), None), (71, prose(5, 20_000), None)]
    return rows


@pytest.mark.parametrize("most", [20_000, 2])
def test_passages_against_brute_force(spark, most):
    rows = passage_rows()
    out = substring_dedup.remove_repeats(docs(spark, rows), most=most).collect()
    assert sorted(map(tuple, out), key=str) == brute_kept(rows)


def test_no_task_holds_a_large_bucket(spark, monkeypatch):
    hashes = substring_dedup.WordHashes()
    least = lambda g: substring_dedup.super_kmers(hashes.of(g.split()), 5, 5)[0].view(np.uint64)[0]
    gram = min((f"g{i} the same five words" for i in range(20_000)), key=least)  # the minimiser of all windows that hold it
    rows = [(i, prose(700 + i, 60) + " " + (gram + " ") * 2 + prose(800 + i, 60), None) for i in range(60)] + [(100 + i, prose(700 + i, 60) + " " + (gram + " ") * 2 + prose(900 + i, 60), None) for i in range(60)]
    sort, most = substring_dedup.sort_buckets, 10

    def guarded(batches, window):
        import pandas as pd

        held = list(batches)
        if held:
            sizes = pd.concat(held).groupby([c for c in ("bucket", "salt") if c in held[0]]).size()
            if len(sizes) and sizes.max() > most:
                raise ValueError(f"{sizes.max()} strings of one bucket in a task")
        yield from sort(iter(held), window)

    monkeypatch.setattr(substring_dedup, "sort_buckets", guarded)
    out = substring_dedup.remove_repeats(docs(spark, rows), most=most).collect()
    assert sorted(map(tuple, out), key=str) == brute_kept(rows)


def test_passages_of_nothing(spark):
    assert substring_dedup.remove_repeats(docs(spark, [])).collect() == []


# -- the pipeline


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "ab"[i % 2] if i is not None else None) for i, t, _ in near_rows()]
    rows += [(5000 + i, prose(900 + i, 70) + f" mail{i}@host.example.com", "c") for i in range(20)]
    df = docs(spark, rows).drop("kept", "spans").withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kept = [(i, t, s) for i, t, s in rows if brute_measures(t)[0] >= 50 and 2 * brute_measures(t)[4] <= brute_measures(t)[0]]
    classes = brute_classes(kept)
    unique = {i: t for (i, t), c in classes.items() if c == i}
    unique[None] = rows[0][1]
    stages = dict(corpus_pipeline.STAGES)
    out = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name in ("quality_rules", "near_dedup", "pii"):
        out = stages[name](spark, out, str(tmp_path))
        assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: re.sub(BASE["email"], "[EMAIL]", t) for i, t in unique.items()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    words = sum(len(WORD.findall(t)) for t in unique.values())
    assert {r["doc_id"] for r in pieces} <= set(unique) and len(pieces) > len(unique)
    assert len({r["sequence_id"] for r in pieces}) * 1024 > 1.5 * words


CLASHES = ["_key", "_position", "_copy", "_part", "_size", "_class_id", "_is_first", "_first", "_t1", "_t2", "_a", "_b", "_spans", "_host", "_host_ok", "_measures", "_base_failed", "_kept", "position", "length"]


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_odd_tables(spark, empty):
    """Nulls in any column, repeated rows, and columns named as the operators' own; or no rows at all."""
    import corpus_pipeline

    rows = [] if empty else [(1, prose(1, 80), "a"), (1, prose(1, 80), "a"), (2, prose(1, 80), "b"), (None, prose(2, 80), None), (3, None, "a"), (4, "", None), (5, "x y", "a"), (6, prose(6, 90) + " a@b.cd", "c")]
    df = spark.createDataFrame([(*r, *["own"] * len(CLASHES)) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES))
    out = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df if name != "source_mix" else out, "")
        assert out.columns == df.columns, name
        got = out.collect()
        assert all(r[c] == "own" for r in got for c in CLASHES), name
        ids = Counter(r["doc_id"] for r in got)
        if name == "quality_rules":
            assert ids == ({} if empty else {1: 2, 2: 1, None: 1, 6: 1})
        if name == "near_dedup":
            assert ids == ({} if empty else {1: 1, None: 1, 3: 1, 4: 1, 5: 1, 6: 1})
        if name == "pii":
            assert ids == Counter(i for i, *_ in rows) and sum("[EMAIL]" in (r["text"] or "") for r in got) == (not empty)
    pieces = corpus_pipeline.STAGES[-1][1](spark, df, "").collect()
    assert Counter(r["doc_id"] for r in pieces) == Counter(i for i, *_ in rows)


def test_packing_keeps_the_order_of_the_files(spark, tmp_path):
    import corpus_pipeline

    df = docs(spark, [(i % 50, prose(i, 30), None) for i in range(100)])
    df.repartition(3).write.parquet(f"{tmp_path}/mixed")
    out = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    assert len({r["position"] for r in out}) == 100 and all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in out)
    by_length = defaultdict(list)
    for r in sorted(out, key=lambda r: (r["length"], r["sequence_id"], r["offset"])):
        by_length[r["length"], r["offset"]].append(r["position"])
    assert all(x == sorted(x) for x in by_length.values())

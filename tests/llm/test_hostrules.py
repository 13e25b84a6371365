import random
import re

from ledgerloom.llm.hostrules import base_metrics, host_verdicts, quality_rules


def plain(text):
    text = text or ""
    w = [x for x in re.split(r"[ \t-\r]+", text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))


def test_metrics_against_brute_force(spark):
    r = random.Random(2)
    texts = [None, "", " \n\t\n", "a", "#|a&b<>%$* é🙂", "x\ny\nx\n\n \nx \nx", " ".join("abcdefgh"), " ".join("abcdefgh" * 2), "a " * 30, "a b " * 9 + "q"]
    for _ in range(60):
        body = [r.choice("ab") * r.randrange(1, 3) for _ in range(r.randrange(1, 80))]
        texts.append("".join(x + r.choice([" ", "  ", "\n", "\t", "\x0b"]) for x in body))
        body = [f"w{r.randrange(300)}" for _ in range(60)]
        texts.append(" ".join(body + body[5 : 5 + r.randrange(20)]))
    df = spark.createDataFrame([(i, t, "h", 9) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_words int")
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) for x in base_metrics(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain(t), t


def test_hosts(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 10 else "bad", "fine") for i in range(200)] + [(1000 + i, good if i % 10 == 0 else "bad", "junk") for i in range(200)]
    rows += [(2000, "bad", "once"), (2001, good, "other"), (2002, good, None), (2003, None, None), (None, good, "junk"), (2002, good, None)]
    out = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows)
    by = {(x.doc_id, x.host): x for x in out}
    assert by[1, "fine"].kept and not by[10, "fine"].kept and not by[10, "fine"].host_rejected
    assert not by[1000, "junk"].kept and by[1000, "junk"].host_rejected and not by[1000, "junk"].base_failed
    assert by[2002, None].kept and not by[2003, None].kept and by[2001, "other"].kept
    flags = spark.createDataFrame([("a", False)] * 50 + [("b", True)], "host string, bad boolean")
    v = {x.host: x for x in host_verdicts(flags, ["bad"]).collect()}
    assert 0 <= v["a"].bad_rate <= v["b"].bad_rate <= 1
    alone = host_verdicts(spark.createDataFrame([("a", True)], "host string, bad boolean"), ["bad"]).first()
    assert alone.bad_rate == 1.0 and alone.host_rejected
    assert quality_rules(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_host_rules_speak_of_hosts_only(spark):
    good, marked = " ".join(f"w{i}" for i in range(30)), " ".join(f"w{i}#" for i in range(30))
    rows = [(i, marked if i % 5 else good, "shop") for i in range(100)] + [(1000 + i, good if i % 5 else marked, "fine") for i in range(100)]
    by = {x.doc_id: x for x in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not by[0].kept and by[0].host_rejected and not by[0].base_failed
    assert by[1000].kept and by[1001].kept


def test_oracle(spark):
    from ledgerloom.llm.queries import ORACLES, QUERIES
    from tests.llm.oracle import same

    same(spark, QUERIES["op8_host_rules"], ORACLES["op8_host_rules"], "/root/testdata/sf0.001")

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from riverlake.llm.secret_scan import BASE_RULES, RULES, Automaton, Rule, find_secrets, scanner, secret_digests
from tests.llm.helpers import DOCS, docs

SIGNS = [
    "password", "PassWd", "secret", "token", "api_key", "apikey", "API", "=", ":", " ", "'", '"', "abc", "0f",
    "deadbeef0123", "AKIA", "ABCDEFGH12", "AKI", "é", "\n", "x.y", "ghp_", "a1B2c3D4e5F6g7H8i9J0k1L2m3N4", "eyJ",
    ".eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "http", "://", "u:", "pw@h", "ſecret", "toKen",
    "xoxb-", "AIza", "sk_live_", "-", "_",
]


def brute(text):
    """Leftmost matches of each rule that do not overlap, less those that fail the check."""
    found = []
    for i, rule in enumerate(RULES):
        pattern = "[0-9a-f]+" if rule.name == "hex" else rule.pattern
        flags = re.ASCII | (re.IGNORECASE if rule.any_case else 0)
        for m in re.finditer(pattern, text or "", flags):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), i, m.end()))
    return sorted(found)


def row(text):
    said = [(i, f"{RULES[i].name}:{s}:{e}") for s, i, e in brute(text)]
    base = ",".join(t for i, t in said if i < 3)
    counts = [sum(i == k for i, _ in said) for k in range(3)]
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(t for _, t in said))


def test_spans_equal_plain_matching():
    find, rng = scanner(tuple(RULES)).spans, random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choices(SIGNS, k=rng.randrange(1, 14)))
        assert find(text) == brute(text), text


def test_failing_matches_still_cover_their_text():
    find = scanner(tuple(RULES)).spans
    assert find("password: token: abcdefghijklmnop") == []
    assert find("password=token=abc-abc-abc") == [(0, 0, 26)]
    assert find("secret = \"abc\" token = 'abcdefghijkl'") == [(15, 0, 36)]
    assert find("é\U0001f642AKIA" + "A" * 13) == [] and find("é\U0001f642AKIA" + "A" * 14) == [(2, 1, 20)]


def test_table_with_nulls_copies_long_texts_and_clashing_names(spark):
    texts = [None, "", "no", "SECRET:abcdefghijkl", "x" * 300_000 + " token=" + "0" * 20, "SECRET:abcdefghijkl"]
    texts += ["AKIA" * 5 + " sk_live_" + "a1" * 12, "é " * 5000 + "0123456789abcdef\n" * 300]
    df = docs(spark, texts, spans=F.lit("x"), n_hex=F.lit(1), id=F.lit(2))
    got = {r.doc_id: tuple(r)[1:] for r in secret_digests(df).collect()}
    assert got == {i: row(t) for i, t in enumerate(texts)}
    assert secret_digests(df).columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert secret_digests(spark.createDataFrame([], DOCS)).collect() == []
    nameless = spark.createDataFrame([(None, "token:aaaaaaaaaaaa")], "doc_id long, text string")
    assert secret_digests(nameless).first().n_assign == 1


def test_spans_as_rows(spark):
    found = find_secrets(docs(spark, ["a 0123456789abcdef", None])).orderBy("doc_id").collect()
    assert [[tuple(s) for s in r.spans] for r in found] == [[("hex", 2, 18)], []]


def test_states_are_minimal():
    rules = [Rule("a", "(ab|cb)x{2,3}"), Rule("b", "b+")]
    joined = Automaton(rules, backwards=False, anywhere=False)
    told = {(m, tuple(r)) for m, r in zip(joined.accepts, joined.table.tolist())}
    assert len(told) == len(joined.accepts)
    assert len(Automaton([Rule("a", "ab|cb")], backwards=False, anywhere=False).accepts) == 4


@pytest.mark.parametrize("pattern", ["[^a]", "é", "a(?=b)", "^a"])
def test_patterns_beyond_the_rules_are_refused(pattern):
    with pytest.raises(ValueError):
        Automaton([Rule("a", pattern)], backwards=False, anywhere=False)


def test_base_rules_come_first():
    assert [r.name for r in BASE_RULES] == ["assign", "access", "hex"]

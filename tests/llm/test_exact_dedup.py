import hashlib
import re

from conftest import CLASHING

from sluice.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

TEXTS = ["a b", "ab", " a\tb\n", None, "", " \r\n\x0b\x0c", "x" * 300_000, "x" * 299_999 + "y", "x" * 300_000 + " ", "a b", "AB"]


def brute(texts):
    clean = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for t in texts]
    found = {}
    for i, c in enumerate(clean):
        same = [j for j, d in enumerate(clean) if c == d]
        keep = min(same, key=lambda j: (-len(texts[j] or ""), j))
        found[i] = (keep, len(same), keep == i, hashlib.sha256(c.encode()).hexdigest())
    return found


def test_groups_as_brute_force(docs):
    rows = exact_duplicates(docs(TEXTS, extra=CLASHING)).collect()
    assert {r.id: (r.keep_id, r.group_size, r.kept, r.digest) for r in rows} == brute(TEXTS)


def test_ties_and_a_large_group(docs):
    texts = ["same"] * 500 + ["other"]
    rows = {r.id: r for r in exact_duplicates(docs(texts)).collect()}
    assert all(rows[i].keep_id == 0 and rows[i].group_size == 500 for i in range(500))
    assert rows[500].kept


def test_empty_table_and_drop(docs):
    assert exact_duplicates(docs([])).count() == 0
    kept = drop_exact_duplicates(docs(TEXTS, extra=CLASHING))
    assert kept.columns == docs([], extra=CLASHING).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in brute(TEXTS).items() if x[2]}

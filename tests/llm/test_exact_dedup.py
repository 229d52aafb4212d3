import pytest
from conftest_llm import rows, sha
from pyspark.sql import functions as F

from larder.llm.exact_dedup import exact_groups

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(docs):
    groups = {}
    for d, t, *_ in docs:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t, *_ in docs:
        ids = groups[t or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d == keep, sha(t)))
    return sorted(out, key=repr)


CASES = {
    "copies and ties": [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, "a ")],
    "null and empty": [(1, None), (2, ""), (3, " "), (None, "x"), (4, "x"), (None, "y"), (None, "y")],
    "hot": [(i, "same") for i in range(200)] + [(1000 + i, f"own {i}") for i in range(50)],
    "long": [(1, "w " * 300_000), (2, "w " * 300_000), (3, "w " * 300_000 + "w")],
    "none": [],
}


@pytest.mark.parametrize("case", CASES)
def test_equals_brute_force(make, case):
    assert rows(exact_groups(make(*CASES[case])), *COLUMNS) == brute(CASES[case])


def test_texts_that_share_a_weak_digest_stay_apart(make):
    docs = [(i, f"{'x' * (i % 5)}{i % 7}") for i in range(60)]
    weak = exact_groups(make(*docs), digest=F.length("body").cast("string"))
    assert rows(weak, *COLUMNS) == brute(docs)

import re

import pytest
from conftest_llm import rows

from larder.llm.line_dedup import dedup_lines, repeated_runs


def units(text):
    """Lines with the blank lines that follow them."""
    out = []
    for line in text.split("\n"):
        if out and not re.search(r"[^\x20\x09-\x0D]", line):
            out[-1].append(line)
        else:
            out.append([line])
    return out


def brute(docs, run):
    """By all windows of lines in order of doc_id; texts must not share an id."""
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        parts = units(t) if t is not None else []
        gone = set()
        for i in range(len(parts) - run + 1):
            window = tuple(p[0] for p in parts[i : i + run])
            if i == 0 and not re.search(r"[^\x20\x09-\x0D]", window[0]):
                continue
            if window in seen:
                gone |= set(range(i, i + run))
            seen.add(window)
        kept = None if t is None else t if not gone else "\n".join(x for i, p in enumerate(parts) if i not in gone for x in p)
        out.append((d, sum(map(len, parts)), sum(len(parts[i]) for i in gone), kept))
    return sorted(out, key=repr)


CASES = {
    "runs": [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd\na\nb"), (4, "c\na")],
    "inside a text": [(1, "a\nb\na\nb\na\nb"), (2, "a\na\na\na")],
    "single line": [(1, "a"), (2, "a"), (3, "a\nq"), (4, "a\nz")],
    "null and empty": [(1, None), (2, ""), (3, "\n\n"), (4, "\n\n\n"), (None, "a\nb"), (9, "a\nb")],
    "hot": [(i, f"u{i}\nhead\nline\nv{i}") for i in range(150)] + [(500 + i, f"line\nn{i}") for i in range(50)],
    "long": [(1, "\n".join(f"l{i}" for i in range(4000))), (2, "\n".join(f"l{i}" for i in range(3990, 8000)) + "\nl1\nl2")],
    "paragraphs": [(1, "\n\na\n\nb\n \nc"), (2, "x\n\na\n\n\ny\n\nb"), (3, "\n\n"), (4, "a\n\n"), (5, "p\n\nq\n\nr")],
    "none": [],
}


@pytest.mark.parametrize("run", [1, 2, 3])
@pytest.mark.parametrize("case", CASES)
def test_equals_brute_force(make, case, run):
    assert rows(dedup_lines(make(*CASES[case]), run), "doc_id", "n_lines", "n_removed", "kept_text") == brute(CASES[case], run)


def test_rows_that_repeat_are_one_document(make):
    docs = [(1, "a\nb"), (1, "a\nb"), (2, "a\nb"), (2, "c\nd")]
    assert rows(dedup_lines(make(*docs), 2), "doc_id", "n_removed", "kept_text") == [(1, 0, "a\nb"), (1, 0, "a\nb"), (2, 0, "c\nd"), (2, 2, "")]


def test_runs_extend_both_ways(make):
    got = repeated_runs(make((1, "p\na\nb\nc\nd\nq"), (2, "r\ns\na\nb\nc\nd\nt")), 3)
    assert rows(got, "doc_id", "first_line", "n_lines", "source_doc", "source_line") == [(2, 2, 4, 1, 1)]

from ledgerline.llm.line_dedup import dedup_lines


def plain(rows):
    """Windows in the order of doc_id and line; rows of one id and text are one document."""
    seen, out = {}, []
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (text or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(line.strip(" \t\r") for line in lines[i : i + 3])
            if not any(window):
                continue
            if window in seen:
                gone |= {i, i + 1, i + 2}
            seen.setdefault(window, (doc_id, i))
        kept = "\n".join(line for i, line in enumerate(lines) if i not in gone)
        out.append((doc_id, text, 0 if text is None else len(lines), len(gone), None if text is None else kept))
    copies = {r: rows.count(r) for r in rows}
    return sorted([(d, n, g, k) for d, t, n, g, k in out for _ in range(copies[d, t])], key=str)


def found(df):
    return sorted([(r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in df.collect()], key=str)


def test_edges(documents):
    rows = [
        (1, "a\nb\nc\nd"), (2, "x\na\nb \nc\ny"), (3, "a\nb\nc\nd"), (3, "a\nb\nc\nd"), (4, None), (5, ""),
        (6, "a\nb"), (7, "\n\n\n\n\n"), (8, "q\nq\nq\nq\nq\nq"), (9, " a\n\tb\r\nc\nd\ne"), (None, "n1\nn2\nn3"), (10, "n1\nn2\nn3\n"),
        (11, "solo"), (12, "b\nc\nd\nz"),
    ]
    result = dedup_lines(documents(rows))
    assert found(result) == plain(rows)
    assert set(documents([]).columns) <= set(result.columns)
    assert {r[name] for r in result.collect() for name in ("base", "text_key", "_found")} == {"?"}


def test_overlaps_in_a_long_document(documents):
    long = "\n".join(f"line {i % 700}" for i in range(5000))
    rows = [(2, long), (1, "line 5\nline 6\nline 7\nline 8"), (3, "alone\n" + long)]
    assert found(dedup_lines(documents(rows))) == plain(rows)


def test_empty_table(documents):
    assert dedup_lines(documents([])).count() == 0


def test_native(documents):
    plan = dedup_lines(documents([(1, "a\nb\nc")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

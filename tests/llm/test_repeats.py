import re

from skyledger.llm import repeats


def units(text):
    """(begin, end, words) of each unit of a text."""
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
    out, own = [], []
    for k, m in enumerate(found):
        own.append(m)
        last = k + 1 == len(found)
        if last or m[0][-1] in ".!?" or "\n" in text[m.end() : found[k + 1].start()]:
            out.append((own[0].start(), own[-1].end(), tuple(re.sub("[A-Z]", lambda c: c[0].lower(), x[0]) for x in own)))
            own = []
    return out


def brute(rows, least):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    first, out = {}, []
    for k in order:
        run = []
        for u in [*units(rows[k][1]), None]:
            if u and u[2] in first:
                run.append((u, first[u[2]]))
                continue
            if run and sum(len(x[2]) for x, _ in run) >= least:
                out.append((rows[k][0], run[0][0][0], run[-1][0][1], sum(len(x[2]) for x, _ in run), len(run), run[0][1]))
            run = []
            if u:
                first[u[2]] = rows[k][0]
    return sorted(out, key=repr)


def got(make, rows, least):
    return sorted((tuple(r) for r in repeats.repeated_runs(make(rows, extra=True), least).collect()), key=repr)


def test_against_brute_force(make, words):
    shared = [words(30, k) + "." for k in range(4)]
    rows = [(k, f"Own É {words(20, 50 + k)}. {shared[k % 4].upper() if k % 3 else shared[k % 4]} 😀 end {k}.\n{shared[(k + 1) % 4]}\nshort line\nshort line") for k in range(40)]
    rows += [(100, None), (101, ""), (102, "no repeat here"), (103, "say it. " * 100), (None, shared[0]), (104, "x" * 300_000 + " y.")]
    for least in (1, 10, 25, 60):
        assert got(make, rows, least) == brute(rows, least)


def test_passage_inside_other_text(make, words):
    passage = ". ".join(words(12, k) for k in range(6)) + "."
    rows = [(k, f"{words(9, 10 + k)} start {passage} {words(9, 20 + k)} done") for k in range(5)] + [(9, words(400, 99))]
    out = got(make, rows, repeats.LEAST_RUN)
    assert [x[0] for x in out] == [1, 2, 3, 4] and all(x[5] == 0 for x in out)
    assert all(x[3] >= 50 for x in out)


def test_equal_rows_count_once_and_empty(make, words):
    text = words(40, 1) + "."
    assert got(make, [(1, text), (1, text)], 25) == []
    assert [x[0] for x in got(make, [(1, text), (1, text), (2, text)], 25)] == [2]
    assert got(make, [], 25) == []


def test_cutting(make, words):
    passage = words(40, 1) + "."
    rows = [(1, f"é first. {passage} tail"), (2, f"😀 second. {passage} rest"), (3, None), (2, "same id, other text"), (4, "")]
    out = {(r.doc_id, r.text): r.removed for r in repeats.without_repeats(make(rows, extra=True)).collect()}
    assert len(out) == 5
    assert out[1, rows[0][1]] == [] and out[3, None] == [] and out[2, "same id, other text"] == [] and out[4, ""] == []
    begin = rows[1][1].index(passage)
    assert out[2, rows[1][1].replace(passage, "")][0].asDict() == {"begin": begin, "end": begin + len(passage)}


def test_short_whole_lines(spark, make, words, tmp_path):
    from skyledger.llm.queries import op10_substring_dedup

    note, two = "Share this page with your friends", "Read on. It is worth it."
    rows = [(k, f"{words(30, k)}\n{note}\n{words(30, 100 + k)}\n{two}\n{words(9, 200 + k)}\nfour words only here") for k in range(4)]
    rows += [(8, f"{words(9, 300)} {note} {words(9, 301)}"), (9, f"{words(9, 302)}\n{note.upper()}\n  {two}\n{words(9, 303)}")]
    rows += [(10, f"{words(5, 400)}. {words(5, 401)}.\nend"), (11, f"{words(5, 401)}.\nno line before"), (12, f"{note}\nx\n{note}")]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted(op10_substring_dedup(spark, str(tmp_path)).collect())
    texts = dict(rows)
    cut = [(r.doc_id, texts[r.doc_id][r.begin : r.end], r.words, r.n_units, r.first_doc_id) for r in out]
    assert cut == [
        *((k, *x) for k in (1, 2, 3) for x in ((note, 6, 1, 0), (two, 6, 2, 0))),
        (9, f"{note.upper()}\n  {two}", 12, 3, 0),
        (12, note, 6, 1, 0),
        (12, note, 6, 1, 0),
    ]

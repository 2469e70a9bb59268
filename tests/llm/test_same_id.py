"""Different texts under one doc_id (op9_line_dedup)."""

from tessera.llm import line_dedup as L


def test_texts_of_one_id_lose_their_own_lines_only(from_rows):
    rows = [(1, "shared line here"), (2, "shared line here\nx"), (2, "a line of its own\ny"), (2, "z\nSHARED LINE HERE"), (2, "shared line here\nx")]
    got = L.line_dedup(from_rows(rows), with_text=True).collect()
    assert sorted((r.doc_id, r.n_dropped, r.text) for r in got) == [(1, 0, "shared line here"), (2, 0, "a line of its own\ny"), (2, 1, "x"), (2, 1, "x"), (2, 1, "z")]

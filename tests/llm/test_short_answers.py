"""Edited copies of short items (op4_decontamination)."""

import pytest

from tessera.llm import decontaminate as D


def index(n):
    w = [f"q{n}x{k}" for k in range(n)]
    k = -(-2 * n // 3)
    others = tuple((i, " ".join(f"o{i}x{j}" for j in range(10)), f"p{i} p{i}y p{i}z") for i in range(2, 30))
    return D.Index(((1, " ".join(w[:k]), " ".join(w[k:])), *others)), w, k


@pytest.mark.parametrize("n", [6, 9, 12, 15, 18, 21, 24])
def test_one_changed_word_at_each_position(n):
    ix, w, _ = index(n)
    for at in range(n):
        for new in (["changed"], [], [w[at], "added"]):
            text = " ".join(["zz"] * 70 + w[:at] + new + w[at + 1 :] + ["yy"] * 70)
            assert [h.item for h in ix.search([text])[0]] == [0], (at, new)


def test_a_question_without_its_answer_is_not_reported():
    for n in (9, 15, 21):
        ix, w, k = index(n)
        for rest in ([], ["another", "answer", "than", "that"], [w[k]], w[k:][::-1], [x for y in w[k:] for x in (y, "far", "away")]):
            assert ix.search([" ".join(w[:k] + rest)])[0] == [], (n, rest)

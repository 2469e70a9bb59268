"""Keys without digits, and keys that look like identifiers (op3_secret_scan)."""

import random
import string

from tessera.llm import secret_scan as C


def found(text):
    return [text[a:b] for _, a, b in C.token_spans(text, C.base_spans(text), C.encodings())]


def test_random_letters_are_found():
    rng = random.Random(4)
    keys = ["qWzXvBnMkLpTrYsDfGhJ"] + ["".join(rng.choices(string.ascii_letters, k=k)) for k in (16, 20, 32) for _ in range(50)]
    assert sum(found(f"key {k} end") == [k] for k in keys) >= 0.97 * len(keys)


def test_random_letters_with_digits_at_the_end_are_found():
    rng = random.Random(5)
    keys = ["".join(rng.choices(string.ascii_letters, k=16)) + rng.choice(["7", "42", "2024"]) for _ in range(50)] + ["qWzXvBnM-kLpTrYsD42", "qWzXvBnM/kLpTrYsD+fGhJ7"]
    assert sum(found(f"key {k} end") == [k] for k in keys) >= 0.95 * len(keys)


def test_words_and_identifiers_are_left_out():
    for clean in ("getUserNameByIdAndDate", "internationalization", "some-long-hyphenated-words", "MAX_CONNECTION_TIMEOUT_MS", "src/main/java/App2/Main", "----------------------", "abcdefabcdefabcdefabcdefabcdefab"):
        assert found(f"see {clean} here") == [], clean

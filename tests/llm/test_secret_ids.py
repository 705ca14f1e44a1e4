"""Product, media and ticket ids beside random strings: what the models call."""

import random
import string

import pytest

from docweave.llm import secrets_scan

B62, UP, LOW, NUM, HEX = string.ascii_letters + string.digits, string.ascii_uppercase, string.ascii_lowercase, string.digits, "0123456789abcdef"


@pytest.fixture(scope="module")
def model():
    return secrets_scan.CharModel(secrets_scan.random_strings(), [])


def share(model, make, n=400):
    rng = random.Random(77)
    draw = lambda letters, k: "".join(rng.choices(letters, k=k))
    return sum(model.is_secret(make(draw, rng)) for _ in range(n)) / n


@pytest.mark.parametrize(
    "make",
    [
        lambda d, r: "B0" + d(UP + NUM, 8),
        lambda d, r: d(B62 + "-_", 11),
        lambda d, r: f"SKU-{d(NUM, 5)}-{r.choice(['XL', 'S', 'M'])}-{d(UP, 3)}",
        lambda d, r: f"{d(UP, 3)}{d(NUM, 4)}-{d(NUM, 3)}{d(UP, 1)}",
        lambda d, r: f"{d(UP, r.randint(2, 6))}-{d(NUM, 5)}",
        lambda d, r: f"ORD-{d(NUM, 4)}-{d(NUM, 4)}-{d(UP, 2)}{d(NUM, 2)}",
        lambda d, r: f"IMG_{d(NUM, 8)}_{d(NUM, 6)}",
        lambda d, r: "978-" + "-".join(d(NUM, k) for k in (1, 5, 3, 1)),
        lambda d, r: "DE" + d(NUM, 20),
        lambda d, r: "AbCdEfGhIjKl",
    ],
)
def test_ids_are_left_alone(model, make):
    assert share(model, make) <= 0.01


@pytest.mark.parametrize(
    "make",
    [
        lambda d, r: "ghp_" + d(B62, 36),
        lambda d, r: "sk_live_" + d(B62, 24),
        lambda d, r: d(B62 + "+/", 40),
        lambda d, r: d(B62, 20),
        lambda d, r: d(B62, 16),
        lambda d, r: d(HEX, 20),
        lambda d, r: "-".join(d(HEX, k) for k in (8, 4, 4, 4, 12)),
    ],
)
def test_random_strings_are_found(model, make):
    assert share(model, make) >= 0.95

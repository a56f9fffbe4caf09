"""Constant propagation over all names, in any order and of any length."""

import time

import pytest

from test_secret_scan import found

A, B = "Zx9kQ2mW7p", "L4vBn8Tr"


@pytest.mark.parametrize("text", [
    f'self.k = "{A}{B}"\npassword = self.k', f'app.main.k = "{A}{B}"\npassword = "${{app.main.k}}"', f'my-key-value: {A}{B}\npassword: my-key-value',
    f'$k = "{A}{B}";\n$password = $k;', f'self.k = "{A}{B}"\npassword = f"{{self.k}}"'])
def test_names_as_written(text):
    assert [f[0] for f in found(text)] == [A + B]


def test_names_used_before_their_definition():
    assert found(f'password: ${{DB_K}}\nDB_K: "{A}{B}"') == [(A + B, "password")]
    assert found(f'password = X\nX = Y + "{B}"\nY = "{A}"') == [(B, "password"), (A, "password")]  # by place
    assert found(f'X = "{A}{B}"\npassword = X\nX = "other_{B}"') == [(A + B, "password")]


def test_cycles_and_chains_end():
    assert found("password = abc\nabc = defg\ndefg = abc") == []
    assert found(f'a0 = "{A}{B}"\n' + "\n".join(f"a{i + 1} = a{i}" for i in range(5000)) + "\npassword = a5000") == [(A + B, "password")]
    start = time.monotonic()
    assert found("token: secret: " * 20_000) == []
    assert time.monotonic() - start < 20


def test_long_values_are_bound():
    long = (A + B) * 4000
    assert found(f'K = "{long}"\npassword = K') == [(long, "password")]

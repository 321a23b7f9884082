"""Secrets however deep they lie, in time linear in the text."""

import time

import pytest

from murmuration.llm import secret_scan

KEY = "Zq8vT2kLp9XwR4"


def found(text):
    return [(text[a:b], name) for a, b, _, name in secret_scan.literals(text)]


@pytest.mark.parametrize("depth", [1, 5, 6, 7, 40])
def test_comments_in_comments(depth):
    assert found("# " * depth + f"passphrase = '{KEY}'") == [(KEY, "passphrase")]
    assert found("// # " * depth + f'"passphrase": "{KEY}"') == [(KEY, "passphrase")]


def test_strings_in_comments_and_comments_in_strings():
    assert found(f"# note: \"passphrase = '{KEY}'\"") == [(KEY, "passphrase")]
    assert found(f'def f():\n  """\n  text\n  # passphrase = "{KEY}"\n  """\n') == [(KEY, "passphrase")]
    assert found(f"/* <!-- \" ` # passphrase = '{KEY}' ` \" --> */") == [(KEY, "passphrase")]


@pytest.mark.parametrize("depth", [1, 5, 8, 30])
def test_blocks_in_blocks(depth):
    text = "".join("  " * k + f"k{k}: |\n" for k in range(depth)) + "  " * depth + f"passphrase: {KEY}\n"
    assert (KEY, "passphrase") in found(text)
    text = "".join(f"cat <<E{k}\n" for k in range(depth)) + f"passphrase={KEY}\n" + "".join(f"E{k}\n" for k in reversed(range(depth)))
    assert (KEY, "passphrase") in found(text)


@pytest.mark.parametrize("braces", [1, 63, 64, 1000])
def test_constants_from_far_out(braces):
    text = f'x = "{KEY}"\n' + "{\n" * braces + "password = x\n" + "}\n" * braces + "token = x\n"
    assert found(text) == [(KEY, "password")]


def test_names_end_with_their_scope():
    assert found(f'{{\nx = "{KEY}"\n}}\npassword = x\n') == []
    assert found(f'x = "plain text"\n{{\nx = "{KEY}"\n}}\npassword = x\n') == [(KEY, "password")]
    assert found(f'def f():\n    x = "{KEY}"\npassword = x\n') == []
    # A brace also closes what is open by indentation in it, and one too many closes nothing.
    assert found(f'}}\nx = "{KEY}"\n{{\n  def f():\n    y = "other"\n}}\n}}\npassword = x\n') == [(KEY, "password")]


@pytest.mark.parametrize("indent", [0, 199, 400, 5000])
def test_deep_indents(indent):
    lead = " " * indent
    assert found(f"key:\n{lead}  passphrase:\n{lead}    value: '{KEY}'\n{lead}  other:\n{lead}    value: '{KEY}'\n") == [(KEY, "passphrase")]


@pytest.mark.parametrize("text", [" # a=b" * 50_000, "".join(f"x=<<A{k}\n" for k in range(20_000)) + "".join(f"A{k}\n" for k in reversed(range(20_000))), "".join(" " * k + "a: |\n" for k in range(900)), "a={" * 100_000 + "}" * 100_000, "".join(" " * (k % 900) + "a:\n" for k in range(2000)) + "}\n" * 100_000, "a='\"`# " * 50_000])
def test_hostile_texts_take_linear_time(text):
    began = time.time()
    secret_scan.literals(text)
    assert time.time() - began < 20

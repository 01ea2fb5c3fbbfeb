"""Assignment-aware lexing against sentences of a written grammar, whose secrets are known."""

import random
import string
import time

import pytest

from skysift.llm import secrets_scan


def named(text):
    return [text[a:b] for a, k, b in secrets_scan.scan(text)[1] if k == 3]


@pytest.mark.parametrize(
    "text, found",
    [
        ('password = """abc123XYZ99qq"""', ["abc123XYZ99qq"]), ("db_password: '''abc123XYZ99qq'''", ["abc123XYZ99qq"]), ("<password>abc123XYZ99</password>", ["abc123XYZ99"]),
        ('<api-key id="7">\n  abc123XYZ99\n</api-key>', ["abc123XYZ99"]), ('const k = "abc123XYZ99"; secretKey = `${k}`', ["abc123XYZ99"]), ('k = "abc123XYZ99"\nsecret_key = f"{k}-77"', ["abc123XYZ99", "-77"]),
        ('secret_key = ("abc123" "XYZ99abc")', ["abc123", "XYZ99abc"]), ('api_secret = "abc123"\napi_secret += "XYZ99abc"', ["abc123", "XYZ99abc"]), ('conf.set("secret_key", "abc123XYZ99")', ["abc123XYZ99"]),
        ('secret_key = "abc123" +\n    "XYZ99abc"', ["abc123", "XYZ99abc"]), ('auth_token = b"abc123XYZ99"', ["abc123XYZ99"]), ('colour = "abc123XYZ99"', []), ("<colour>abc123XYZ99</colour>", []), ('say("hello", "abc123XYZ99")', []),
        ('password = ""', []), ("password = changeme", []), ('secret_key = `${unknown}`', []), ("<password></password>", []), ('a = "abc123XYZ99"\nsecret_key = (a)', ["abc123XYZ99"]), ('password = """', []), ('password = f""', []),
    ],
)
def test_syntax(text, found):
    assert named(text) == found


def test_grammar():
    """Random programs: every secret that reaches a sensitive name by any path is found, whole, and nothing that does not."""
    rng = random.Random(4)
    fresh = lambda: "".join(rng.choices(string.ascii_letters + string.digits, k=9)) + "a1B2"
    quote = lambda x: rng.choice(['"{}"', "'{}'", '"""{}"""', "`{}`"]).format(x)
    for _ in range(300):
        lines, secrets, others = [], set(), set()
        for n in range(rng.randint(1, 8)):
            hot = rng.random() < 0.5
            name = rng.choice(["api_secret", "DB_PASSWORD", "authToken", "signingSecret"] if hot else ["colour", "titleText", "width_of"]) + str(n)
            x, y = fresh(), fresh()
            kept = secrets if hot else others
            form = rng.randrange(9)
            if form == 0:
                lines.append(f"{name}{rng.choice([' = ', ': ', ' := ', ' => ', '='])}{quote(x)}")
            elif form == 1:
                lines += [f"part{n} = {quote(x)}", f"{name} = part{n}"]
            elif form == 2:
                lines.append(f"{name} = {quote(x)} + {quote(y)}")
                kept.add(y)
            elif form == 3:
                lines.append(f'{name} = ("{x}"\n    "{y}")')
                kept.add(y)
            elif form == 4:
                lines += [f"{name} = {quote(x)}", f"{name} += {quote(y)}"]
                kept.add(y)
            elif form == 5:
                lines += [f"part{n} = {quote(x)}", f"{name} = `${{part{n}}}`"]
            elif form == 6:
                lines.append(f"<{name}>{x}</{name}>")
            elif form == 7:
                lines.append(f'settings.put("{name}", {quote(x)})')
            else:
                lines.append(f'{{"{name}": "{x}", "other{n}": 1}}')
            kept.add(x)
        text = "\n".join(lines)
        assert set(named(text)) == secrets, text
        assert not others & set(named(text))


def test_hostile_texts_take_linear_time():
    for text in ('a="""' + "x" * 400_000, "a=" + '"""' * 100_000, "a=(" * 100_000, "<a>" * 100_000, "a=f" * 100_000, 'x = ("a" ' * 50_000, "a=b+" * 100_000, "`${a}" * 80_000, '("a",' * 80_000, "<password" + " x" * 200_000):
        began = time.time()
        secrets_scan.scan(text)
        assert time.time() - began < 10, text[:20]

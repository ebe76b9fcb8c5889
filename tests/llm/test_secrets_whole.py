"""Secrets and endpoints are linked without an access identifier, and spans that hold other spans are found."""

from helixframe.llm import secrets


def kinds(text):
    return [k for k, _, _ in secrets.spans(text)]


def test_secret_beside_an_endpoint():
    assert kinds("db at postgres://db.internal with password: hunter22 set") == ["endpoint", "weak_value"]
    assert kinds("see https://api.host/v1 key Ab3dEf6hIj9kLmN2pQr5sT") == ["endpoint", "weak_secret"]
    assert kinds("https://h/a deadbeefdeadbeef") == ["endpoint", "hex"]
    assert kinds("https://h/a " + "x" * 301 + " password: hunter22") == []
    assert kinds("https://h/Ab3dEf6hIj9kLmN2pQr5sT and https://h/b") == []  # part of an address
    assert kinds("password: hunter22") == kinds("https://h/a") == []


def test_span_that_holds_a_shorter_one():
    parts = [("assign", 0, 500), ("hex", 10, 30), ("hex", 600, 620)]
    assert secrets._within(parts, *secrets._bounds(parts), 400, 610) == [parts[0], parts[2]]
    value = "=" * 300 + "deadbeefdeadbeef" + "=" * 400  # the identifier's scope meets the long value, not the hex inside it
    t = f"secret={value} client_id: abcd"
    assert "weak_id" in kinds(t)

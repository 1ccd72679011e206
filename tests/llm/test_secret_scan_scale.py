"""Secret scans of long texts: time in proportion, and the same keys as in short ones."""

import base64
import time

import pytest

from logweave.llm import secret_scan as S

SIZE = 10_000_000


def b64(data: bytes) -> str:
    return base64.b64encode(data).decode()


def nested(content: bytes, tag: int = 0x30) -> bytes:
    n = len(content)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + content


RSA = nested(b"\x02\x01\x00" + b"".join(nested(bytes([k + 1]) * 60, 0x02) for k in range(8)))
ED25519 = nested(bytes.fromhex("020100300506032b6570") + nested(b"\x04\x20" + b"k" * 32, 0x04))


def ssh(keys: int, public: int = 51, private: int = 200) -> bytes:
    field = lambda x: len(x).to_bytes(4, "big") + x
    return S.SSH_MAGIC + field(b"none") + field(b"none") + field(b"") + keys.to_bytes(4, "big") + field(b"p" * public) * keys + field(b"s" * private)


HOSTILE = {
    "heads of OpenSSH blocks": "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAA\n",
    "magic words of OpenSSH blocks": "b3BlbnNzaC1rZXkt" + "A" * 30 + "\n",
    "keys that claim a long length": b64(bytes.fromhex("3084004c4b40020100") + bytes(24)) + "\n",
    "numbers that claim a long length": b64(bytes.fromhex("3084009896800201000201000201000201000201000201000201000201000284009896") + b"x") + "\n",
    "algorithms of keys": b64(bytes.fromhex("30840010000002010030840000800006032b6570") + bytes(13)) + " ",
    "one long run": "M",
    "tokens without an end": "eyJa.",
    "hex without an end": "30" + "a" * 60 + "g ",
    "names without a value": "token    ",
}


@pytest.mark.parametrize("form", HOSTILE)
def test_ten_megabytes_of_hostile_text(form):
    part = HOSTILE[form]
    began = time.process_time()
    S.scan(part * (SIZE // len(part)))
    assert time.process_time() - began < 10  # some 5 s and less where nothing else runs


@pytest.mark.parametrize("data, kind", [(RSA, "der_key"), (ED25519, "der_key"), (ssh(1), "ssh_key"), (ssh(40), "ssh_key")])
def test_keys_behind_long_hostile_text(data, kind):
    """A key after 100 KB of each hostile form is found, with its lines parted in any way."""
    text = b64(data)
    for part in HOSTILE.values():
        before = part * (100_000 // len(part)) + "\n\n.\n"
        for gap in ("\n", "\r\n    ", "\\n"):
            lines = gap.join(text[k : k + 64] for k in range(0, len(text), 64))
            found = [s for s in S.scan(f"{before}-----{lines}\n-----END") if s[0] == kind]
            assert (kind, len(before) + 5, len(before) + 5 + len(lines)) in found


def test_an_openssh_block_of_many_keys_ends_where_its_fields_do():
    text = b64(ssh(40))
    assert S.scan(f"key {text} and words")[-1] == ("ssh_key", 4, 4 + len(text))
    # a wrong length: the block goes on with its lines
    cut = b64(ssh(3)[:200])
    assert S.scan(f"key {cut[:100]}\n{cut[100:]} and words")[-1][:2] == ("ssh_key", 4)


def test_wrong_structures_are_no_keys():
    for data in (nested(b"\x02\x01\x00" * 8), nested(b"\x02\x01\x00" * 11), nested(bytes.fromhex("020100300506032b6571") + nested(b"k" * 40, 0x04))):
        assert not [s for s in S.scan(b64(data + bytes(40))) if s[0] == "der_key"]


def test_very_long_text_of_distinct_words_and_candidates():
    words = " ".join(f"w{k}x" for k in range(200_000))
    text = f"{words} {b64(ED25519)} {words} token={'q' * 12} {words}"
    assert [s[0] for s in S.scan(text) if s[0] in ("der_key", "assign")] == ["der_key", "assign"]

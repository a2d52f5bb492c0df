"""A private key is masked from BEGIN to END."""

from splitmill.llm import secrets

LINES = "MIIEpAIBAAKCAQEA7bq+/x\nAbCdEfGhIjKlMnOpQr0123\nq8Zz+A=="


def test_key_spans(spark):
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    cases = {
        f"a\n{begin}\n{LINES}\n{end}\nb": "a\n[private_key]\nb",
        f"a {begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{LINES}": "a [private_key]",
        f"{begin}\r\n" + LINES.replace("\n", "\r\n") + "\r\nand so on": "[private_key]\r\nand so on",
        '{"k": "' + f"{begin}\n{LINES}".replace("\n", "\\n") + '\\n", "x": 1}': '{"k": "[private_key]\\n", "x": 1}',
        f"{begin} is how a key begins.\nNo key here": "[private_key] is how a key begins.\nNo key here",
        f"{begin}\n{LINES}\n-----BEGIN PRIVATE KEY-----\n{LINES}\n-----END PRIVATE KEY-----": "[private_key]\n[private_key]",
        f"{begin}\n{LINES}\n-----END PRIVATE KEY-----": "[private_key]\n-----END PRIVATE KEY-----",
        f"é {begin}\n" + "0a" * 20 + f"\n{end}.": "é [private_key].",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.mask_secrets(rows, ["doc_id"]).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values())
    hit = secrets.text_spans(f"{begin}\n{'0a' * 20}\n{end}".encode())
    assert [k for _, k, _ in hit] == ["private_key", "hex"]  # base spans stay

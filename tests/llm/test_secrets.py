import base64
import json

import pytest

from talkloom.llm import secrets as S

WORDS = dict.fromkeys(["your", "api", "key", "token", "trigram", "retention", "value", "password", "the", "for", "now", "login", "with", "index", "retry", "budget", "estimator", "window", "first", "pass"], 10)
R1, R2 = "q7XkP2" * 5 + "Zw9", "9f3c" * 7  # neither is a known digest length
PW = "Zk8!" + "vQx2"
PEM = "-----BEGIN " + "RSA PRIVATE KEY-----\n" + "MIIabc123\n" * 3 + "-----END " + "RSA PRIVATE KEY-----"
CASES = [
    (f'API_KEY = "{R1}"', {"api_key"}), (f"export A_TOKEN={R1}", {"token"}), (f"Authorization: Bearer {R2}", {"token"}), (f"headers['Authorization'] = 'Bearer ' + '{R1}'", {"token"}),
    (f"curl -H 'X-Api-Key: {R2}' https://h", {"api_key"}), (f'key = "{R1[:16]}" + \\\n  "{R1[16:]}"  # api key', {"api_key"}), (f'const bot = login("{R1}"); // bot token', {"token"}),
    (f"dsn = 'postgres://u:{PW}@h:5432/d'", {"password"}), (f"git clone https://oauth2:{R1}@h/x.git", {"token"}), (f"sshpass -p {PW} ssh h", {"password"}), (f"curl -u 'admin:{PW}' https://h", {"password"}),
    (f'<add key="DbPassword" value="{PW}" />', {"password"}), (f"# DB のパスワードは {PW} です", {"password"}), (f"login with the password {PW} for now", {"password"}), (f"spring.datasource.password={PW}", {"password"}),
    (PEM, {"private_key"}), ('"private_key": "' + PEM.replace("\n", "\\n") + '"', {"private_key"}), ("AKIA" + "ABCDEFGH12345678", {"api_key"}), (f"client = Client('{R1}')", {"api_key"}),
    ("  token: " + base64.b64encode(R1.encode()).decode(), {"token"}),
    ("password: ${DB_PASSWORD}", set()), ("token = {{ vault.bot_token }}", set()), ("API_KEY=<your-api-key>", set()), ("pwd = getpass.getpass()", set()), ("secret: ********", set()),
    ("tokenizer: trigram", set()), ("max_tokens: 4096", set()), ("sha256: " + "0a" * 32, set()), ("commit " + "0a" * 20, set()), ("id: 80f3f726-238e-4b9a-a3c8-8c85316fdc9e", set()),
    ("-----BEGIN PUBLIC KEY-----\nabc\n-----END PUBLIC KEY-----", set()), ("Authorization: Bearer [REDACTED:bearer]", set()), ("api_key = os.environ['A_API_KEY']", set()), ("", set()), ("the key is unique", set()),
]


@pytest.mark.parametrize("text, want", CASES)
def test_types(text, want):
    kinds, masked = S.scan_text(text, S.Segmenter(WORDS))
    assert set(kinds) == want
    assert len(masked) == len(text) and (masked != text) == bool(want)


def test_mask_keeps_code():
    assert S.scan_text(f'x = 1\nAPI_KEY = "{R1}"  # why\n', S.Segmenter(WORDS))[1] == f'x = 1\nAPI_KEY = "{"*" * len(R1)}"  # why\n'


@pytest.mark.parametrize("text", [t for t, _ in CASES])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_payload_still_parses(text, ascii_only):
    payload = json.dumps({"a": [text + " 日本"], "b": {"c": text}, "n": 1}, ensure_ascii=ascii_only)
    kinds, masked = S.scan_payload(payload, S.Segmenter(WORDS))
    assert set(kinds) == set(S.scan_text(text + " 日本", S.Segmenter(WORDS))[0]) | set(S.scan_text(text, S.Segmenter(WORDS))[0])
    got = json.loads(masked)
    assert got["n"] == 1 and (got["b"]["c"] == text) == (not S.scan_text(text, S.Segmenter(WORDS))[0])


def test_segmentation():
    s = S.Segmenter({"token": 3, "key": 5, "index": 2})
    assert s.residual("token-key_index") == 0 and s.residual("tokenxyz") == 3 and s.residual("") == 0


def test_find(spark):
    rows = [(str(i), t) for i, (t, _) in enumerate(CASES)] + [("n", None), ("0", CASES[0][0]), ("long", "index " * 30_000 + CASES[0][0])]
    df = spark.createDataFrame(rows, "row_key string, text string")
    out = {r.row_key: r for r in S.find(df, ["row_key"], "text", WORDS).collect()}
    for i, (t, want) in enumerate(CASES):
        assert set(out[str(i)].types) == want, t  # so the prefilter loses nothing
    assert out["n"].masked is None and set(out["long"].types) == {"api_key"}
    assert "index" in S.dictionary(df.select("text")) and S.find(df.limit(0), ["row_key"], "text", WORDS, payload=True).count() == 0


@pytest.mark.parametrize("ascii_only", [True, False])
def test_find_in_payloads(spark, ascii_only):
    own = [*CASES, (f"ENV X_ACCESS_KEY {R1}", {"api_key"}), (f"DB のパスワードは {PW} です", {"password"}), (f"APIキーは {R1}", {"api_key"})]
    strings = [(before + t, want) for before in ("", "FROM x\n", "a\tb\r\n", '"q" ', "c:\\d ") for t, want in own]
    rows = [(str(i), json.dumps({"a": [t], "n": 1}, ensure_ascii=ascii_only)) for i, (t, _) in enumerate(strings)]
    out = {r.row_key: r for r in S.find(spark.createDataFrame(rows, "row_key string, text string"), ["row_key"], "text", WORDS, payload=True).collect()}
    for key, payload in rows:
        assert (out[key].types, out[key].masked) == S.scan_payload(payload, S.Segmenter(WORDS)), payload
    assert all(want <= set(out[str(i)].types) for i, (_, want) in enumerate(strings))


@pytest.mark.parametrize(
    "payload, want",
    [
        ({"password": PW}, {"password"}), ({"api_key": R1}, {"api_key"}), ({"env": {"DB_PASSWORD": PW, "MODE": "read"}}, {"password"}), ({"headers": {"Authorization": f"Bearer {R1}"}}, {"token"}),
        ({"env": [{"name": "BOT_TOKEN", "value": R1}]}, {"token"}), ({"tokens": [R1, R2]}, {"token"}),
        ({"password": "your-password"}, set()), ({"token": "retry_budget_estimator"}, set()), ({"api_key": "${API_KEY}"}, set()), ({"sha256": "0a" * 32}, set()), ({"n": 1}, set()),
    ],
)
def test_member_names_are_contexts(spark, payload, want):
    text = json.dumps(payload)
    kinds, masked = S.scan_payload(text, S.Segmenter(WORDS))
    assert set(kinds) == want and (json.loads(masked) != payload) == bool(want)
    out = S.find(spark.createDataFrame([("1", text)], "row_key string, text string"), ["row_key"], "text", WORDS, payload=True).first()
    assert set(out.types) == want  # the prefilter lets it through


def test_masking_of_payloads_escaped_otherwise():
    text = '{"url": "https:\\/\\/u:' + PW + '@h", "same": "' + PW + '"}'
    kinds, masked = S.scan_payload(text, S.Segmenter(WORDS))
    assert kinds == ["password"] and PW not in json.loads(masked)["url"]


def test_the_segmentation_decides():
    """Replaced by a count of characters, plain words near credential names become secrets."""

    class Counting(S.Segmenter):
        def residual(self, literal):
            return sum(c.isalnum() for c in literal)

    texts = ["token = retry_budget_estimator_window", "the first pass. password: your-retry-window", "api_key = your_password_for_login"]
    assert all(S.scan(t, S.Segmenter(WORDS)) == [] for t in texts)
    assert all(S.scan(t, Counting(WORDS)) != [] for t in texts)


def test_split_literals_are_judged_as_one():
    half = "AKIA" + "AF6VEZ", "NRQ7IIZG4U"
    assert S.scan_text(f'key = "{half[0]}" + \\\n      "{half[1]}"  # api key', S.Segmenter(WORDS))[0] == ["api_key"]


def test_session_ids_are_no_secrets(spark):
    ids = ["3bfbb5e8-366abdad", "80f3f726-238e-4b9a-a3c8-8c85316fdc9e", "0a" * 16]
    rows = [(f"{k} {v}", json.dumps({"type": "user", k: v, "text": "password: none"})) for k in ("sessionId", "session", "session_id", "sid") for v in ids]
    out = S.find(spark.createDataFrame(rows, "row_key string, text string"), ["row_key"], "text", WORDS, payload=True).collect()
    assert len(out) == len(rows) and all(r.types == [] and r.masked == dict(rows)[r.row_key] for r in out)
    assert S.scan_text(f"INFO session_id={ids[0]} opened", S.Segmenter(WORDS))[0] == []
    for text in (f"Cookie: lang=en; sessionid={ids[1]}", f"Cookie: session_token={ids[0]}", f"sid={R1}"):
        assert S.scan_text(text, S.Segmenter(WORDS))[0] == ["token"]
    for member in ({"sessionToken": ids[0]}, {"session_secret": ids[1]}, {"session": R1}):
        assert S.scan_payload(json.dumps(member), S.Segmenter(WORDS))[0]


def test_the_prefilter_loses_nothing_that_scan_finds(spark):
    texts = [f"DB_PASS={PW}", f"pw = '{PW}'", f"jwt: {R1}", f"session: {R1}", f"Token {R1}", f"Authorization: Basic\t{R1}", f"bearerAuth={R1}", f"set X_PASS {PW}", f"APP_PASS\u3000=\u3000{PW}", f"access key id = {R2}", f"toKen² = {R1}", "SG." + R1[:20] + "." + R1[:20]]
    out = S.find(spark.createDataFrame([(t,) for t in texts], "text string"), ["text"], "text", WORDS).collect()
    assert len(out) == len(texts) and all(r.types and (r.types, r.masked) == S.scan_text(r.text, S.Segmenter(WORDS)) for r in out)
    payloads = [{"pass": PW}, {"e": [{"value": PW, "name": "DB_PASSWORD"}]}, {"e": [{"value": R1, "name": "api key"}]}, {"tokens": [[R1]]}, {"jwt": R1}, {"session": R1}, {"a": f"DB_PASS={PW}"}]
    texts = [json.dumps(p, indent=i, separators=s) for p in payloads for i, s in ((None, None), (2, (" ,", " :  ")))]
    out = S.find(spark.createDataFrame([(t,) for t in texts], "text string"), ["text"], "text", WORDS, payload=True).collect()
    assert len(out) == len(texts) and all(r.types and (r.types, r.masked) == S.scan_payload(r.text, S.Segmenter(WORDS)) for r in out)


def test_repeated_members_are_all_masked():
    text = f'{{"password": "{PW}", "a": {{"token": "{R1}", "token": "none"}}, "password": "{PW}9"}}'
    kinds, masked = S.scan_payload(text, S.Segmenter(WORDS))
    assert kinds == ["password", "token"] and masked == text.replace(R1, "*" * len(R1)).replace(PW + "9", "*" * len(PW + "9")).replace(PW, "*" * len(PW))

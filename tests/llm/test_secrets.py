import random
import string

from fathomlake.llm import secrets

from .conftest import prose, row, rows

R = random.Random(11)
HEX = "".join(R.choice("0123456789abcdef") for _ in range(40))
KEY = "".join(R.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(36))


def found(make, text, **options):
    return [(r.position, r.n_chars) for r in secrets.scan(make([row(1, text)]), **options).orderBy("position").collect()]


def test_finds_random_strings_where_they_are(make):
    text = f'{prose(2, 50)} token = "{HEX}" and {KEY}.'
    assert found(make, text) == [(text.index(HEX), 40), (text.index(KEY), 36)]


def test_leaves_out_digests_identifiers_and_names(make):
    clean = [
        f"commit {HEX} of a repository", "id 123e4567-e89b-12d3-a456-426614174000 here", "call 2669109448945250123456 now",
        "on 2024-01-31-12-30-45-00 it", "donaudampfschifffahrtsgesellschaft1", "in_this_very_long_function_name_2 there", prose(3, 300),
    ]
    assert [found(make, t) for t in clean] == [[]] * len(clean)


def test_known_strings_are_skipped(make):
    assert found(make, f"key: {KEY}", known=(KEY.upper(),)) == []


def test_secret_at_the_end_of_a_very_long_text(make):
    text = prose(4, 40_000) + " secret=" + KEY
    assert found(make, text) == [(text.index(KEY) - len("secret="), 36 + len("secret="))] or found(make, text) == [(text.index(KEY), 36)]


def test_masks(make):
    got = secrets.scan(make([row(1, f"token: {KEY}")])).first()
    assert KEY not in str(got) and got.masked.startswith(KEY[:4])
    assert got.ratio == got.n_chars / got.n_tokens < 2.2


def test_edge_cases(edge, empty, make):
    assert rows(secrets.scan(edge)) == [] and secrets.scan(empty).count() == 0
    twice = make([row(None, f"token = {HEX}")] * 2)
    assert [r.doc_id for r in secrets.scan(twice).collect()] == [None, None]


def random_strings(letters, n, count=200, seed=5):
    r = random.Random(seed)
    return ["".join(r.choice(letters) for _ in range(n)) for _ in range(count)]


def share_found(make, lines, strings):
    """The share of strings of which the report of their own line says exactly the place."""
    got = {(r.doc_id, r.position, r.n_chars) for r in secrets.scan(make([row(i, t) for i, t in enumerate(lines)])).collect()}
    return sum((i, t.index(s), len(s)) in got for i, (t, s) in enumerate(zip(lines, strings))) / len(lines)


def test_keys_of_letters_only(make):
    mixed, lower = random_strings(string.ascii_letters, 24), random_strings(string.ascii_lowercase, 16)
    assert share_found(make, [f"see {s} here" for s in mixed], mixed) >= 0.99
    assert share_found(make, [f"password: {s}" for s in lower], lower) >= 0.93
    numbered = [s + "7" for s in lower]
    assert share_found(make, [f"password: {s}" for s in numbered], numbered) >= 0.9


def test_names_and_paths_do_not_dilute_a_secret(make):
    base62 = string.ascii_letters + string.digits
    short, long = random_strings(base62, 16), random_strings(base62, 20)
    for line, strings in (("database_password={}", short), ("authentication_token={}", long), ("www.example.com/account/reset/password/token/{}", long), ("production-administrator-authentication-configuration_{}", long)):
        assert share_found(make, [line.format(s) for s in strings], strings) >= 0.99, line


def test_base64_is_taken_whole(make):
    base64 = [s + "==" for s in random_strings(string.ascii_letters + string.digits + "+/", 38)]
    assert share_found(make, [f"value {s} end" for s in base64], base64) >= 0.93
    assert found(make, "see /home/people/documents/reports/summary/index.html") == []


def test_digests_after_a_name_or_a_path(make):
    integrity = random_strings(string.ascii_letters + string.digits + "+/", 64, 1)[0]
    clean = [
        f"sha1={HEX}", f"the sha1-{HEX}", f"/objects/store/{HEX}.json", f"https://example.com/blobs/sha1/{HEX}", f'integrity="sha384-{integrity}"', "id=123e4567-e89b-12d3-a456-426614174000",
    ]
    assert [found(make, t) for t in clean] == [[]] * len(clean)
    text = f"access_token={HEX}"
    assert found(make, text) == [(text.index(HEX), 40)]
    assert found(make, f"key={KEY}", known=(KEY.upper(),)) == []


def test_short_keys_passwords_and_dates_before_a_key(make):
    mixed, lower15 = random_strings(string.ascii_letters + string.digits, 12), random_strings(string.ascii_lowercase, 15)
    assert share_found(make, [f"key {s} here" for s in mixed], mixed) >= 0.98
    assert share_found(make, [f"pin {s} here" for s in lower15], lower15) >= 0.9
    signs = [s[:5] + "!" + s[5:9] + "@" + s[9:] + "7" for s in random_strings(string.ascii_letters + string.digits, 12)]
    assert share_found(make, [f"password: {s} ok" for s in signs], signs) >= 0.98
    long = random_strings(string.ascii_letters + string.digits, 28)
    for prefix in ("2024-01-", "10.0.0.", "12-34-", "2024-01-31T"):
        assert share_found(make, [f"see {prefix}{s} here" for s in long], long) >= 0.98, prefix
    clean = ["mail bob.42@mail9.example.com now", "Wörterbuchübersetzung", "a %D0%BF%D1%80%D0%B8%D0%B2%D0%B5%D1%82 b", "**********************", "at 192.168.100.200/24 or 2024-01-31T12", "----------------"]
    assert [found(make, t) for t in clean] == [[]] * len(clean)


def by_hand(text, counted):
    """Keys between spaces or quotes, judged with another tokenizer's counts and no regular expression."""
    key, out, cursor = set(string.ascii_letters + string.digits), [], 0
    for word in text.replace('"', " ").split():
        word = word.strip(".,;:!?#$%&*|")
        cursor = text.index(word, cursor) + len(word)
        if len(word) >= 16 and set(word) <= key and any(c.isdigit() for c in word) and not word.isdigit():
            at = cursor - len(word)
            named = any(w in text[max(0, at - 48) : at].lower() for w in ("token", "key", "secret", "password"))
            digest = len(word) in (32, 40, 64) and set(word.lower()) <= set("0123456789abcdef")
            if (named or not digest) and len(word) / counted(word) < 2.2:
                out.append((at, len(word)))
    return out


def test_against_a_scanner_by_hand_on_given_documents(spark):
    from fathomlake.llm.tokencount import Merger, TokenCounter, load_ranks

    ranks = load_ranks()
    counter = TokenCounter(ranks, Merger(ranks))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {(r.doc_id, *hit) for r in docs.collect() if r.text for hit in by_hand(r.text, lambda w: counter.counts([w])[0])}
    got = {(r.doc_id, r.position, r.n_chars) for r in secrets.scan(docs).collect()}
    assert want and want <= got
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(text[i][a : a + n].isalpha() for i, a, n in got - want)  # other reports are invented words

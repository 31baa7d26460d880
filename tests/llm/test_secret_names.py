from packledger.llm import secret_scan


def named(text):
    return [text[a:b] for a, b, k in secret_scan.spans(text) if k == "named"]


def test_names_with_digits_are_followed():
    assert named('KEY_V2 = "Zq8#kLw9x"\ntoken = KEY_V2') == ["Zq8#kLw9x"]
    assert named("DB_PASS_2=Zq8#kLw9x\npassword = ${DB_PASS_2}") == ["Zq8#kLw9x"]
    assert named('SIGNING_V2 = "plain"\nclient_secret = SIGNING_V2') == []  # the name is not the literal
    assert named("db_pwd = Zq8kLw9xQ") == ["Zq8kLw9xQ"]  # nothing of that name: a literal


def test_concatenations_are_one_value():
    text = 'api_key = "sk-ab" + "c9d8e7" + "f6g5h4"'
    assert named(text) == ["sk-ab", "c9d8e7", "f6g5h4"]
    assert secret_scan.redact(text) == 'api_key = "[named]" + "[named]" + "[named]"'
    assert named('a1 = "sk-ab"\nb = "c9d8e7"\nc = a1 + b + "f6g5h4"\napi_key = c') == ["sk-ab", "c9d8e7", "f6g5h4"]
    assert named('title = "sk-ab" + "c9d8e7" + "f6g5h4"') == []
    assert named('api_key = "a" + "b"') == []


def test_circles_and_doublings_end():
    assert named('token = k1 + "x"\nk1 = token + "y"') == []
    lines = ['k0 = "Zk3"'] + [f"k{i + 1} = k{i} + k{i}" for i in range(60)]
    assert named("\n".join([*lines, "token = k60"])) == []


def test_other_syntaxes():
    key = "Zk3!9fQ#aa1x"
    assert named(f'<add key="password" value="{key}"/> <add key="title" value="{key}"/>') == [key]
    assert named(f"define('DB_PASSWORD', '{key}'); define('DB_TITLE', '{key}')") == [key]
    assert named(f"<conf><password>\n {key} </password><title>{key}</title></conf>") == [key]
    assert named(f"db_pwd = `{key}`") == [key] and named(f'db_pwd = rb"{key}"') == [key] and named(f"pwd = f'{key}' + u'x'") == [key]
    assert named(f"db:\n  password: |\n    {key}\n    Qw9_tail7\n  title: |\n    {key}\nx: 1") == [key, "Qw9_tail7"]
    assert named(f"secret_key: >-\n  sk-ab\n  c9d8e7\n  f6g5h4\nname: {key}") == ["sk-ab", "c9d8e7", "f6g5h4"]


def test_values_of_pieces_look_like_their_text():
    import random
    rng = random.Random(4)
    for _ in range(3000):
        parts = ["".join(rng.choice("aZ3 x.-<e>\tno") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 5))]
        if rng.random() < 0.2:
            parts += ["exam", "ple"] if rng.random() < 0.5 else ["no", "ne"]
        value = secret_scan._Value()
        for p in parts:
            value.add(secret_scan._Value(p))
        assert abs(value.score() - secret_scan.literal_score("".join(parts))) < 1e-9, parts


def test_long_chains_take_time_in_proportion():
    import time
    n = 10_000
    chained = "\n".join(['token_0 = "a"', *(f'token_{i} = token_{i - 1} + "x{i}"' for i in range(1, n))])
    plain = "\n".join(['token_0 = "Zk3_9fQaa1"', *(f"token_{i} = token_{i - 1}" for i in range(1, n))])
    shared = "\n".join(['k = "Zk3"', *(f'token_{i} = k + "x{i}"' for i in range(1, n))])
    circle = "\n".join(f'token_{i} = token_{(i * 7 + 1) % n} + token_{(i + 1) % n} + "x{i}"' for i in range(n))
    xml, block = "<a " * n + "<b>" * n + "a(" * n, "\n".join("  " * (i % 50) + "password: |" for i in range(n))
    for text in (chained, plain, shared, circle, xml, block, "a" * 100_000, "token=" * n, '"' * n, "x:" * n, "`" * n):
        start = time.process_time()
        secret_scan.spans(text)
        took = time.process_time() - start
        assert took < 3, (text[:40], took)
    assert len(named(chained)) > n / 2 and named(plain) == ["Zk3_9fQaa1"]

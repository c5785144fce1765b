import hashlib
import random

import public_tokenizers as P
from tokenizers import Tokenizer

from strata.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, window int, loss string"
TRICKY = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|im_end|>\n", "|><|", "", None, "é" * 40, "<|im_start|>user\n", "a\\nb"]


def turns(seed=1, conversations=12):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        n = rng.choice([1, 2, 3, 8, 40])
        for t in range(n):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2] if rng.random() < 0.9 else rng.choice(["assistant", "tool", None, "odd\nrole", "back\\slash"])
            text = rng.choice(TRICKY) if rng.random() < 0.3 else " ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice([1, 20, 200])))
            rows.append((c if c else None, t, role, text, 1, "x"))
    rows += [(77, 0, "user", "same", 1, "x")] * 2 + [(78, None, "assistant", "no turn", 1, "x"), (78, 1, "user", "later", 1, "x")]
    return rows


def ordered(rows):
    convs = {}
    for c, t, role, text, *_ in rows:
        convs.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}


def test_windows_read_back(spark):
    rows = turns()
    want = ordered(rows)
    frame = chat.windows(spark.createDataFrame(rows, SCHEMA), budget=200, history=60)
    got = {}
    for r in frame.collect():
        got.setdefault(r["conv_id"], []).append(r)
    assert set(got) == set(want)
    for c, windows in got.items():
        windows.sort(key=lambda r: r["window"])
        new, loss = [], []
        for i, r in enumerate(windows):
            assert r["window"] == i
            parsed = chat.parse(r["text"])
            assert len(parsed) == r["n_repeated"] + r["n_new"] and r["n_new"] > 0
            repeated = parsed[: r["n_repeated"]]
            if want[c][0][0] == "system" and i:
                assert repeated[0] == want[c][0]
                repeated = repeated[1:]
            assert repeated == new[len(new) - len(repeated) :]
            assert sum(chat.turn_tokens(x) for _, x in repeated) <= 60
            assert r["tokens"] == sum(chat.turn_tokens(x) for _, x in parsed)
            assert r["tokens"] <= 200 or r["n_new"] == 1
            new += parsed[r["n_repeated"] :]
            loss += [chat.unescape(r["text"][s["begin"] : s["end"]]) for s in r["loss"]]
        assert new == want[c]
        assert loss == [x for role, x in want[c] if role == "assistant"]


def test_digests(spark):
    rows = turns(5)
    want = ordered(rows)
    windows = chat.windows(spark.createDataFrame(rows, SCHEMA))
    chars = {}
    for r in windows.collect():
        chars[r["conv_id"]] = chars.get(r["conv_id"], 0) + len(r["text"])
    got = {r["conv_id"]: r for r in chat.digests(windows).collect()}
    assert set(got) == set(want)
    for c, v in want.items():
        r, loss = got[c], "".join(x for role, x in v if role == "assistant")
        assert r["n_turns"] == len(v)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in v).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == chars[c]
    assert chat.digests(chat.windows(spark.createDataFrame([], SCHEMA))).count() == 0


def test_escape_is_reversible():
    rng = random.Random(3)
    for _ in range(3000):
        s = "".join(rng.choice("<|\\n\na>") for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        role = chat.escape_role(s)
        assert chat.unescape_role(role) == s and "\n" not in role and "<|" not in role


def test_budget_holds_in_the_tokens_of_a_tokenizer(spark):
    rows, path = turns(3), P.path("byte_bpe_50k.json")
    # no special tokens: the control strings are ordinary text, as in windows()
    other = Tokenizer.from_file(path)

    def count(text):
        return len(other.encode(text, add_special_tokens=False).ids)

    got = chat.windows(spark.createDataFrame(rows, SCHEMA), 200, 60, path, P.PATTERN).collect()
    assert sum(r["n_new"] for r in got) == len(rows)
    for r in got:
        assert r["tokens"] == count(r["text"])
        assert r["tokens"] <= 200 or r["n_new"] == 1
    # the estimate doesn't hold it
    assert any(r["n_new"] > 1 and count(r["text"]) > 200 for r in chat.windows(spark.createDataFrame(rows, SCHEMA), 200, 60).collect())

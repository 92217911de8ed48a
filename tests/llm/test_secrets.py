"""Secrets: examples of every format, and keys within longer runs."""

import math
import random
import string

from lineloom.llm import secrets

from .test_ops import documents


def test_every_format_keeps_its_examples(spark):
    rng = random.Random(31)
    texts = [f"secret = {''.join(rng.choices(string.ascii_lowercase, k=rng.randint(6, 11)))}" for _ in range(3000)]
    lengths = range(20, 60, 2)
    for n in lengths:
        texts += ["token: q7z" + "".join(rng.choices(string.ascii_uppercase + string.digits * 3, k=n - 3)) for _ in range(40)]
    model = secrets.fit(documents(spark, texts))
    for n in lengths:
        token = "q7z" + "".join(rng.choices(string.ascii_uppercase + string.digits * 3, k=n - 3))
        assert model.automata[f"assign{n}"].beginning == "q7z" and model.automata[f"assign{n}"].shortest == n
        assert model.learned(f"see {token} there")[0][:2] == (4, 4 + n), token
    # Words in assignments are examples too, but no word is likelier as a secret than as a word.
    assert any(k in model.automata for k in ("assign6", "assign7", "assign8")) and model.learned("internationalisation of the longest words") == []


def test_keys_within_runs():
    rng = random.Random(32)
    pairs = secrets.pair_counts([" ".join(rng.choices(["the", "of", "internationalisation", "name", "value", "long", "path"], k=4000))])
    model = secrets.Model({k: secrets.Automaton(v) for k, v in secrets.made_examples().items()}, secrets.Background(pairs.astype(float)))
    letters = string.ascii_letters + string.digits
    keys = ["ghp_" + "".join(rng.choices(letters, k=36)), "sk_live_" + "".join(rng.choices(letters, k=24)), "AIza" + "".join(rng.choices(letters + "_-", k=35))]
    keys += ["ghp_" + "".join(rng.choices(string.ascii_letters, k=36)), "sk_live_" + "".join(rng.choices(string.ascii_lowercase, k=24))]  # no digits
    for key in keys:
        for text in (key, f"GH_PAT={key}", f"see https://x.io/{key} now", f"https://x.io/{key}/a.git?b", f"a.b-{key}", f"MY_{key}", f"x:{key}.", f"'{key}'"):
            at = text.index(key)
            base, every, ratios = secrets.spans(text, model)
            assert [s for s in every if s not in base] == [("learned", at, at + len(key))] and ratios[0] > secrets.PRIOR, text
            assert key not in secrets.redacted(text, every)
    assert secrets.spans("/usr/share/internationalisation-of/some.very.long.path.name=value", model)[1] == []
    two = f"{keys[0]}={keys[1]}"
    assert [s[1:] for s in secrets.spans(two, model)[1]] == [(0, 40), (41, len(two))]


def test_all_documents_and_values_count(spark):
    rng = random.Random(33)
    values = ["q" + "".join(rng.choices(string.ascii_lowercase, k=29)) for _ in range(1200)]
    values += ["x" + "".join(rng.choices(string.ascii_uppercase, k=29))]  # one of another form
    texts = [f"token: {v}" for v in values] + [f"{'ab'[i % 2]}~{i % 7}" for i in range(66_000)]
    model = secrets.fit(documents(spark, texts).repartition(5))
    m = model.automata["assign30"]
    assert m.beginning == "" and m.likelihood(values[-1]) > -math.inf
    assert m.steps == secrets.Automaton(values).steps
    assert (model.background.log == secrets.Background(secrets.pair_counts(texts)).log).all()


def test_states_that_meet_again_are_counted_once():
    rng = random.Random(34)
    values = [rng.choice(["Aa", "0z"]) + "".join(rng.choices("0aA" if i % 3 else "zZ", k=8)) for i in range(3000)]
    m = secrets.Automaton(values)
    assert m.states < 9 * 5**secrets.ORDER
    # All that the automaton leaves at each state adds up to one.
    for step, end in zip(m.steps, m.ends, strict=True):
        share = sum(math.exp(p - secrets._SHARE.get(c, 0.0)) for c, (_, p) in step.items()) + (math.exp(end) if end is not None else 0)
        assert abs(share - 1) < 1e-9

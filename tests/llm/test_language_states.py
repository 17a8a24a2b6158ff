"""The byte network: gradients against differences, and windows against a reading of each text in one go."""

import numpy as np
import pytest

from corpusloom.llm import language


def plain(model, text):
    """Probabilities at every byte, by a loop over single bytes and whole states."""
    u, p = model.units, {k: v.astype(np.float64) for k, v in model.p.items()}
    soft, sides = (lambda x: x / (1 + np.abs(x))), []
    for way in (0, 1):
        h, states = np.zeros(u), []
        for byte in text if way == 0 else text[::-1]:
            a, s = p[f"in{way}"][:, byte], p[f"rec{way}"] @ h
            z, r = (soft(a[: 2 * u] + s[: 2 * u]) + 1).reshape(2, u) / 2
            h = z * h + (1 - z) * soft(a[2 * u :] + r * s[2 * u :])
            states.append(h)
        sides.append(np.array(states if way == 0 else states[::-1]))
    e = np.exp(np.concatenate(sides, 1) @ p["out"].T + p["bias"].T)
    return e / e.sum(1, keepdims=True)


@pytest.fixture
def texts():
    rng = np.random.default_rng(3)
    sizes = [1, language.WINDOW - 1, language.WINDOW, language.WINDOW + 1, 5 * language.WINDOW + 7, 0, 40, 9 * language.WINDOW]
    return [rng.integers(32, 128, n, np.uint8).tobytes() for n in sizes]


@pytest.mark.parametrize("block", [1, 2, 3, 2048])
@pytest.mark.parametrize("slow", [0.0, 3.0])
def test_states_go_on_through_a_text(texts, block, slow, monkeypatch):
    """Whatever the blocks (texts of several blocks too), and for gates that forget slowly (run-ups fail): each byte's probabilities are those of one reading."""
    monkeypatch.setattr(language, "BLOCK", block)
    model = language.ByteGru(["a", "b", "c"])
    for way in (0, 1):
        model.p[f"in{way}"][: model.units, : language.PAD] += slow
    pooled, seen = model.pooled(texts), []
    for k, text in enumerate(texts):
        want = plain(model, text) if text else np.zeros((0, 3))
        got = [prob.transpose(2, 0, 1).reshape(-1, 3) for _, _, prob in model.positions([text])]
        got = np.concatenate(got)[: len(text)] if got else np.zeros((0, 3))
        assert got.shape == want.shape and np.abs(got - want).max(initial=0) < 0.03
        assert np.abs(pooled[k] - (want.mean(0) if text else 0)).max() < 0.03
        seen.append((model.labels(text) == want.argmax(1)).mean() if text else 1)
    assert np.mean(seen) > 0.98


def test_a_label_reaches_beyond_windows_and_run_ups():
    """A byte at the start of a text sets a state that is kept: the last byte, three windows on, has its label."""
    model = language.ByteGru(["a", "b"], units=1)
    for k in ("in0", "in1", "rec0", "rec1", "out"):
        model.p[k][:] = 0
    for way in (0, 1):
        model.p[f"in{way}"][0] = 1e12  # keep
    model.p["in0"][0, ord("!")], model.p["in0"][2, ord("!")] = -1e12, 1e12  # take
    model.p["out"][1, 0] = 9
    text = b"!" + b"x" * (3 * language.WINDOW)
    assert model.labels(text).tolist() == [1] * len(text) and model.labels(text[1:]).tolist() == [0] * (len(text) - 1)


def test_gradients(monkeypatch):
    """Against central differences of the mean cross-entropy, with padding and run-ups that do not count."""
    monkeypatch.setattr(language, "WINDOW", 5)
    monkeypatch.setattr(language, "RUN_UP", 3)
    model = language.ByteGru(["a", "b", "c"], units=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    codes, of = language.windows([b"abcabcab", b"ba", b"cab"])
    codes, target = np.ascontiguousarray(codes.T), np.array([0, 1, 2])[of]

    def loss():
        both = np.concatenate([model._read(codes, 0), model._read(codes, 1)], 1)
        logits = np.matmul(model.p["out"], both) + model.p["bias"]
        log = logits - np.log(np.exp(logits).sum(1, keepdims=True))
        counts = (codes != language.PAD)[3:8]
        return -(log[3:8, target, np.arange(len(of))] * counts).sum() / counts.sum()

    found = model.gradients(codes, target)
    for k, held in model.p.items():
        for at in np.ndindex(held.shape):
            if k.startswith("in") and at[1] not in b"abc":
                assert abs(found[k][at]) < 1e-12  # exactly zero in the single precision that is trained in
                continue
            was, ends = held[at], []
            for by in (1e-5, -1e-5):
                held[at] = was + by
                ends.append(loss())
            held[at] = was
            assert abs((ends[0] - ends[1]) / 2e-5 - found[k][at]) < 1e-6, (k, at)

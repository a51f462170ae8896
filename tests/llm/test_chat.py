import hashlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstack.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


@settings(deadline=None, max_examples=80)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a|>\n", "<end>\n", "end", ""]), st.text(max_size=40)), max_size=5))
def test_render_and_parse(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted.encode()[a:b].decode()) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    encode, size = chat.tokenizer(chat.default_tokenizer())
    ids = np.array(encode.encode(formatted, allowed_special="all"), np.int64)
    assert encode.decode_bytes(ids.tolist()) == formatted.encode()
    ends = np.cumsum(size[ids])
    mask, parts = chat.masked(spans, ends - size[ids], ends)
    assert parts == [s for s in spans if s[0] < s[1]]  # no token leaves a text
    assert encode.decode_bytes(ids[mask].tolist()) == b"".join(formatted.encode()[a:b] for a, b in spans)


def test_masks_by_brute_force():
    starts, ends = np.array([0, 3, 4, 5, 9]), np.array([3, 4, 5, 9, 12])
    for spans in ([(0, 12)], [(4, 4)], [(1, 4), (6, 7)], [(3, 5)], [(2, 3), (3, 9)]):
        mask, parts = chat.masked(spans, starts, ends)
        want = [any(s < b and e > a for a, b in spans if a < b) for s, e in zip(starts, ends)]
        assert mask.tolist() == want
        assert {c for a, b in parts for c in range(a, b)} == {c for a, b in spans for c in range(a, b)}


def test_query_rows(spark):
    rows = [(1, 0, "user", "</s>[INST] <|end|> 🙂é\\"), (1, 1, "assistant", "  lead and trail \n"), (1, 2, "assistant", None), (1, None, None, "x"), (2, 0, "assistant", "a" * 50_000), (None, 0, "user", "n"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", formatted int")
    formatted = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    groups = defaultdict(list)
    for c, turn, role, text in rows:
        groups[c].append((-1 if turn is None else turn, role or "", text or ""))
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in formatted.collect():
        assert len(r["input_ids"]) == len(r["loss_mask"])
        body = r["formatted"].replace("<|", "").replace("|>", "")
        assert "</s>" not in body and "[INST]" not in body
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0

import hashlib

from contentgauge.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, n int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)), len(loss), sha(loss))
    return out


def test_what_is_formatted_is_read_back(frame):
    rows = [
        (1, 1, "assistant", "a\\<|im_end|>\n<|im_start|>user\nno", 0), (1, 0, "user", "\\n \\\\ <", 0), (1, 2, "user", None, 0),
        (2, 0, "sys\ntem", "", 0), (2, 1, "assistant", "😂<", 0), (2, 1, "assistant", "|x", 0),
        (None, None, None, None, None), (3, 0, "assistant", "z" * 100_000, 0),
    ]
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame(rows, SCHEMA))).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in got.items()} == expected(rows)
    assert all(r.n_rewritten == 0 for r in got.values())


def test_a_declared_reach_bounds_the_history():
    seen = []

    def template(turns):
        seen.append(len(turns))
        return chat.marked_turns(turns)

    state, out = chat.Renderer(template, reach=0), ""
    turns = [("user" if k % 2 else "assistant", f"text {k}") for k in range(50)]
    for role, text in turns:
        part, begin, end, rewritten = state.add(role, text)
        assert not rewritten and chat.plain(part[begin:end]) == text
        out += part
    assert out == chat.marked_turns(turns) and max(seen) <= 10
    assert chat.Renderer(chat.marked_turns).reach == 0


def test_prefixes_are_whole_without_a_declared_reach():
    def numbered(turns):
        return "".join(f"[{k}]{t}" for k, (_, t) in enumerate(turns))

    def window(turns):  # forgets turns beyond 100
        return "".join(f"<{t}>" for _, t in turns[-100:])

    state, out = chat.Renderer(numbered), ""
    for k in range(150):
        out += state.add("user", f"t{k};")[0]
    assert out == numbered([("user", f"t{k};") for k in range(150)])
    state = chat.Renderer(window)
    flags = [state.add("user", f"t{k};")[3] for k in range(150)]
    assert flags == [False] * 100 + [True] * 50


def test_a_system_turn_that_moves_is_flagged():
    def moved(turns):  # the system text goes before the last user turn
        system = "".join(t for r, t in turns if r == "system")
        last = max((k for k, (r, _) in enumerate(turns) if r == "user"), default=-1)
        return "".join(f"<{system if k == last else ''}{t}>" for k, (r, t) in enumerate(turns) if r != "system")

    state = chat.Renderer(moved)
    turns = [("system", "S!")] + [(("user", "assistant")[k % 2], f"t{k}") for k in range(160)]
    flags = [state.add(*t)[3] for t in turns]
    assert all(flags[k] for k in range(3, 161, 2))  # every later user turn moves it


def test_ids_keep_their_type(frame):
    rows = [("b", 0, "user", "x", 0), ("a", 1, "assistant", "y", 0), ("a", 0, "user", "z", 0), (None, 0, "assistant", "n", 0)]
    got = chat.read_back(chat.format_turns(frame(rows, SCHEMA.replace("conv_id long", "conv_id string"))))
    assert {r.conv_id: r.n_turns for r in got.collect()} == {"b": 1, "a": 2, None: 1}


def test_a_template_that_rewrites_history_is_flagged():
    def last_only(turns):  # drops the reasoning of all but the last turn
        return "".join(f"<{t if k + 1 == len(turns) else t[:1]}>" for k, (_, t) in enumerate(turns))

    state = chat.Renderer(last_only)
    flags = [state.add("assistant", t)[3] for t in ("abc", "def", "g")]
    assert flags == [False, True, True]


def test_empty_table(frame):
    assert chat.read_back(chat.format_turns(frame([], SCHEMA))).collect() == []

"""Plain Python models of the text steps, written for the tests only."""

import re

BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)


def trim(s):
    return s.strip(BLANKS)


def split_lines(text):
    rows = text.split("\n")
    if rows[-1] == "":
        rows.pop()
    return [r[:-1] if r.endswith("\r") else r for r in rows]


def _c(line, state):
    if state == "B":
        if "*/" not in line:
            return None, "B"
        line = line.split("*/", 1)[1]
    line = re.sub(r"/\*.*?\*/", "", line, flags=re.S)
    if "/*" in line:
        return line.split("/*", 1)[0], "B"
    if trim(line).startswith("//"):
        return None, "N"
    return line.split("//", 1)[0], "N"


def _hash(line, state, py):
    if state != "N":
        if state not in line:
            return None, state
        line = line.split(state, 1)[1]
    state = "N"
    if py:
        for quote in ('"""', "'''"):
            if quote in line:
                before, rest = line.split(quote, 1)
                if quote in rest:
                    line = before + rest.split(quote, 1)[1]
                else:
                    line, state = before, quote
                break
    if trim(line).startswith("#!"):
        return line, state
    if trim(line).startswith("#"):
        return None, state
    return line.split("#", 1)[0], state


def strip(text, ext):
    out, state = [], "N"
    for line in split_lines(text):
        if ext in (".go", ".js", ".c"):
            now, state = _c(line, state)
        elif ext in (".py", ".sh"):
            now, state = _hash(line, state, ext == ".py")
        elif ext in (".html", ".xml"):
            t = trim(line)
            whole = t.startswith("<!--") and t.endswith("-->")
            now = None if whole else re.sub(r"<!--.*?-->", "", line, flags=re.S)
        else:
            now = line
        if now is None:
            continue
        if trim(now):
            out.append(now)
        elif not trim(line) and out and out[-1] != "":
            out.append("")
    return "\n".join(out)


def unpack_xml(text):
    blocks, state, path, held = [], "O", "", []
    for line in split_lines(text):
        t = trim(line)
        if state == "O":
            m = re.search(r"""<file[\t\n\f\r ]+path=["']([^"']+)["'][^>]*>""", line)
            if m:
                path, state, held = m.group(1), "I", []
        elif t == "</file>" or (state == "C" and t == "]]>"):
            blocks.append((path, "\n".join(held)))
            state = "O"
        elif t == "<![CDATA[":
            state = "C"
        elif state == "C" and t.endswith("]]>"):
            held.append(line[:-3] if line.endswith("]]>") else line)
            blocks.append((path, "\n".join(held)))
            state = "O"
        else:
            held.append(line)
    return blocks


def unpack_markdown(text):
    blocks, state, path, held = [], "O", "", []
    for line in split_lines(text):
        fence = trim(line).startswith("```")
        if state == "O":
            m = re.match(r"##[\t\n\f\r ]+File:[\t\n\f\r ]*([^\t\n\f\r ()]+)", line)
            if m:
                path, state, held = m.group(1), "H", []
        elif state == "H":
            if fence:
                state = "K"
        elif fence:
            blocks.append((path, "\n".join(held)))
            state = "O"
        else:
            held.append(line)
    return blocks


def next_fit(tokens, room):
    part, used, filled, out = 1, 0, False, []
    for t in tokens:
        if filled and used + t > room:
            part, used = part + 1, 0
        out.append((part, used))
        used += t
        filled = True
    return out


def moved_bytes(df):
    """Bytes of the rows that the shuffles of ``df`` moved; runs it."""
    df.collect()
    waiting, total = [df._jdf.queryExecution().executedPlan()], 0
    while waiting:
        node = waiting.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            waiting.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            waiting.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                total += node.metrics().apply("dataSize").value()
            waiting += [node.children().apply(i) for i in range(node.children().size())]
    return total

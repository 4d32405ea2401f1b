"""Line shapes one line after the other, as the rules say it."""

import re

DIGIT = "[0-9٠-٩۰-۹]"
NUMBER = rf"{DIGIT}(?:[0-9٠-٩۰-۹/\-.\s]*{DIGIT})?\s*(?:هـ|ه|م)?"


def letter(s):
    return any(c.isalpha() for c in s)


def field(s):
    m = re.match(r"([^:：]{1,32}?)\s*([:：])\s*(.*\S)$", s)
    if m and letter(m[1]) and not re.search(DIGIT + "$", m[1]) and not re.match(r"([^:：]{1,32}?)\s*([:：])\s*(.*\S)$", m[3]):
        return m[1], m[2], m[3]


def tail(s, held):
    m = re.match(rf"([^0-9٠-٩۰-۹|:：]*[^0-9٠-٩۰-۹|:：\s])\s+({NUMBER})$", s)
    return [m[1], m[2]] if m and letter(m[1]) and len(m[1].split()) <= 5 and m[1].lower() not in held else None


def shapes(lines, labels, held=()):
    """(number, shape, cells) of the lines of one text; labels and headings in lower case."""
    lines = [(i, " ".join(t.split())) for i, t in lines if t.strip()]
    known = lambda s: s.lower() in labels and s.lower() not in held
    out = []
    while lines:
        (i, s), rest = lines[0], lines[1:]
        nxt = rest[0][1] if rest else None
        if nxt and known(s) and not known(nxt) and "|" not in s + nxt and not field(s) and not field(nxt):
            out.append([i, s, [s, nxt], None])
            rest = rest[1:]
        else:
            cells = None
            if "|" in s:
                parts = [c.strip() for c in s.split("|") if c.strip()]
                cells = parts if len(parts) > 1 else None
            elif (f := field(s)) and known(f[0]):
                cells = [f[0] + f[1], f[2]]
            elif len(s) <= 60 and s.lower() not in held:
                w = s.split()
                n = max((n for n in range(1, min(5, len(w) - 1) + 1) if known(" ".join(w[:n]))), default=0)
                cells = [" ".join(w[:n]), " ".join(w[n:])] if n else None
            out.append([i, s, cells, field(s)])
        lines = rest
    for k, (_, _, cells, f) in enumerate(out):
        if cells is None and f and (k and out[k - 1][3] or k + 1 < len(out) and out[k + 1][3]):
            out[k][2] = [f[0] + f[1], f[2]]
    tails = {k for k, x in enumerate(out) if x[2] is None and tail(x[1], held)}
    changed = True
    while changed:
        changed = False
        for k in sorted(tails):
            if out[k][2] is None and (k and out[k - 1][2] or k + 1 < len(out) and out[k + 1][2]):
                out[k][2] = tail(out[k][1], held)
                changed = True
    done, k = [], 0
    cells = [x[2] for x in out]
    while k < len(out):
        i, s, c, _ = out[k]
        near = k and cells[k - 1] or k + 2 < len(out) and cells[k + 2]
        if k + 1 < len(out) and near and c is None and cells[k + 1] is None and re.match(rf"{NUMBER}$", out[k + 1][1]) and letter(s) and not re.search(DIGIT, s) and len(s.split()) <= 5 and s.lower() not in held and "|" not in s:
            done.append((i, "row", [s, out[k + 1][1]]))
            k += 2
            continue
        letters, digits = sum(ch.isalpha() for ch in s), len(re.findall(DIGIT, s))
        heading = len(s.split()) <= 6 and len(s) <= 48 and letter(s) and not (digits >= letters and digits) and not (k in tails) and not re.search("[.،:؛]$", s)
        done.append((i, "row" if c else "heading" if heading else "body", c))
        k += 1
    return done

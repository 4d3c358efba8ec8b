"""Sections, packing and windows of one file as plain loops, to compare plans with."""

from loam.sources import markdown


def windows(text, limit, overlap):
    """Character by character, without looking anything up."""
    t, out, at = text.strip(), [], 0
    if limit <= 0 or len(t) <= limit:
        return [t] if t else []
    while True:
        end = len(t)
        if at + limit < len(t):
            end = at + limit
            for k in range(at, at + limit):
                if t[k].isspace() and k - at > limit // 2:
                    end = k
        if t[at:end].strip():
            out.append(t[at:end].strip())
        if end == len(t):
            return out
        at = end - overlap if end - overlap > at else end
        while t[at].isspace():
            at += 1


def assemble(titles, body):
    title = " > ".join(t.strip() for t in titles if t.strip())
    return "\n\n".join(x for x in (title, body.strip()) if x)


def sections(text, base):
    path, out, titles, body = [], [], list(base), []
    for level, block in markdown.blocks(text):
        if level:
            if body:
                out.append((titles, body))
            path = path[: min(level - 1, len(path))] + [block]
            titles, body = [*base, *path], []
        else:
            body.append(block.strip())
    if titles or body:
        out.append((titles, body))
    return out


def pieces(titles, body, s):
    whole = assemble(titles, "\n\n".join(body))
    if not whole or len(whole) <= s.most:
        return [whole] if whole else []
    prefix = assemble(titles, "")
    room = s.most - (len(prefix) + 2 if prefix else 0)
    out, held = [], []
    for block in [*body, None]:
        if block is not None and len(assemble(titles, "\n\n".join([*held, block]))) <= s.most:
            held.append(block)
            continue
        if held:
            out.append(assemble(titles, "\n\n".join(held)))
            held = []
        if block is not None and len(assemble(titles, block)) <= s.most:
            held = [block]
        elif block is not None:
            out += [assemble(titles, p) for p in windows(block, room if room > 0 else s.most, s.overlap)]
    return out


def split(text, base, s):
    """(title path, content) of each chunk."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    short = assemble(base, text)
    if short and len(short) <= s.short_file:
        return [(base, short)]
    return [(titles, p) for titles, body in sections(text, base) for p in pieces(titles, body, s)]

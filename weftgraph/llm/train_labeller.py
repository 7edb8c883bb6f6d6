"""Fits the block labeller on generated pages: python -m weftgraph.llm.train_labeller.

The generator draws templates of many kinds: semantic elements or bare divs, usual class names or
none, boilerplate before, after and within the article, unclosed tags; words are invented.
"""

from __future__ import annotations

import random

import numpy as np

from .html import HIDDEN, INNER, PATHS, SHAPE, WORDS, Labeller, blocks, bucket, path

# Class names in common use on the web.
ROLES = {
    "nav": "nav menu navigation navbar breadcrumb breadcrumbs links topnav tabs pagination pager toc".split(),
    "header": "header masthead topbar branding logo head banner hero".split(),
    "footer": "footer foot bottom copyright colophon legal".split(),
    "aside": "sidebar aside side rail widget related recommended popular trending more secondary".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted banner adsense".split(),
    "notice": "cookie notice consent gdpr alert popup modal overlay message announcement warning paywall".split(),
    "form": "form newsletter subscribe signup login search contact".split(),
    "comments": "comments comment replies reply discussion respond disqus".split(),
    "share": "share social sharing follow tags meta byline".split(),
}
MAIN = "content article post entry story main body text page copy news blog".split()
ELEMENT = {"nav": ["nav"], "header": ["header"], "footer": ["footer"], "aside": ["aside"], "ad": ["aside", "div"], "notice": ["div", "section"], "form": ["form"], "comments": ["section", "div"], "share": ["div"]}
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve la ra ño ción ß ü ö eau oi ch qu pa mi".split()
SAY = {  # fixed values: usual words of boilerplate
    "nav": "Home About Contact News Blog Products Services Help FAQ Login Archive".split(),
    "footer": "© 2020 All rights reserved Privacy Terms Imprint".split(),
    "notice": "We use cookies to improve your experience Accept OK".split(),
    "form": "Email Subscribe Send Search Name Password Submit".split(),
    "comments": "Reply says wrote Comments Leave a comment".split(),
    "share": "Share Tweet Facebook Like Print Tags By Posted".split(),
    "ad": "Advertisement Sponsored Buy now".split(), "aside": "Related Popular Recent Read more".split(), "header": "Welcome Site".split(),
}


class Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        r = self.r
        return "".join(r.choice(SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        n = self.r.randint(low, high)
        return " ".join(self.word() for _ in range(n)).capitalize() + self.r.choice("...?!")

    def prose(self, long: bool) -> str:
        r = self.r
        if long and r.random() < 0.05:  # junk is prose too
            t = r.choice((self.word(), self.sentence(2, 4), self.word().upper() + "!!", self.word() + " |"))
            return " ".join([t] * r.randint(5, 60))
        if not long or r.random() < 0.12:
            return " ".join(self.word() for _ in range(r.randint(1, 6))) + r.choice(("", ".", "."))
        return " ".join(self.sentence() for _ in range(r.randint(1, 7))).replace(" an ", r.choice((" &amp; ", " an ", " &eacute; ")))

    def inline(self, t: str) -> str:
        r, w = self.r, t.split()
        if len(w) > 4 and r.random() < 0.25:
            i = r.randrange(len(w) - 1)
            w[i] = r.choice((f'<a href="/{i}">{w[i]}</a>', f"<b>{w[i]}</b>", f"<em>{w[i]}</em>", f"<span>{w[i]}</span>"))
        return " ".join(w)

    def mark(self, label: int, t: str) -> str:
        self.truth.append((label, t))
        return t

    def attrs(self, role: str | None, names: list[str]) -> str:
        r = self.r
        if role is None or r.random() < 0.25:
            return r.choice(("", "", ' class="wrap"', ' class="row"', ' class="box"', ' class="inner"'))
        name = r.choice(names)
        name = r.choice((name, name, f"site-{name}", f"{name}-wrap", f"{name} block", f"main-{name}" if role != "main" else name, f"{name}Box", name.capitalize()))
        return f' {r.choice(("class", "class", "id"))}="{name}"'

    def boiler(self, kind: str) -> str:
        r, m = self.r, lambda t: self.mark(0, t)
        tag = r.choice(ELEMENT[kind]) if r.random() < 0.6 else "div"
        known = tag != "div"
        at = self.attrs(kind, ROLES[kind])
        if not known and "=" not in at or at.split('"')[1:2] in (["wrap"], ["row"], ["box"], ["inner"]):
            at = self.attrs(kind, ROLES[kind]) if not known else at
        short = lambda: " ".join(r.choice(SAY[kind]) if r.random() < 0.4 else self.word() for _ in range(r.randint(1, 4)))
        style = r.random()
        if kind in ("nav", "share") or (kind in ("aside", "footer", "header") and style < 0.5):
            if r.random() < 0.75:
                items = "".join(f'<li><a href="/{i}">{m(short())}</a>' + r.choice(("</li>", "</li>", "")) for i in range(r.randint(2, 9)))
                body = f"<ul>{items}</ul>"
            else:
                body = m(" ".join(f'<a href="/{i}">{short()}</a>' for i in range(r.randint(2, 8))))
            if kind == "aside" and r.random() < 0.5:
                body = f"<h3>{m(short())}</h3>" + body
        elif kind == "comments":
            body = f"<h3>{m(short())}</h3>" if r.random() < 0.7 else ""
            for _ in range(r.randint(1, 5)):
                inner = f"<p>{m(self.prose(True))}</p>"
                who = f"<span>{m(short())}</span>" if r.random() < 0.5 else ""
                wrap = r.choice(("li", "div", "article"))
                body += f'<{wrap}{r.choice(("", " class=comment", " class=\"comment-body\""))}>{who and f"<div>{who}</div>"}{inner}</{wrap}>'
        elif kind == "form":
            body = r.choice(("", f"<p>{m(self.prose(r.random() < 0.4))}</p>")) + f'<label>{m(short())}</label><input name="q">'
            body = f'<div>{body}</div><div><button>{m(short())}</button></div>'
        else:
            p = self.prose(r.random() < 0.75)
            body = m(p) if r.random() < 0.5 else f"<p>{m(p)}</p>"
            if kind == "footer" and r.random() < 0.6:
                self.truth.pop()
                body = m("&copy; " + short() + " &middot; " + p)
        if kind == "form" and r.random() < 0.7:
            tag = "form"
        return f"<{tag}{at}>{body}</{tag}>"

    def article(self) -> str:
        r, m = self.r, lambda t: self.mark(1, t)
        out = [f"<h1>{m(self.prose(False))}</h1>"] if r.random() < 0.8 else []
        broken = r.random() < 0.35
        for _ in range(r.choice((1, 2, 3, 5, 8, 12, 20))):
            k = r.random()
            if k < 0.04 and len(out) > 2:  # the same paragraph again and again
                t = self.prose(r.random() < 0.5)
                out += [f"<p>{m(t)}</p>" for _ in range(r.randint(2, 25))]
            elif k < 0.74:
                t = m(self.inline(self.prose(r.random() < 0.85)))
                close = "" if broken and r.random() < 0.4 else "</p>"
                out.append(r.choice((f"<p>{t}{close}", f"<p><b>{t}<br>" if broken else f"<p>{t}</p>", f"<p>{t}{close}")))
            elif k < 0.8:
                out.append(f"<{(h := r.choice(('h2', 'h3')))}>{m(self.prose(False))}</{h}>")
            elif k < 0.88:
                out.append(f"<{(u := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{m(self.prose(r.random() < 0.5))}</li>" for _ in range(r.randint(2, 6))) + f"</{u}>")
            elif k < 0.92:
                out.append(f"<blockquote>{r.choice(('', '<p>'))}{m(self.prose(True))}</blockquote>")
            elif k < 0.95:
                out.append(f"<div>{m(self.prose(True))}</div>")
            elif len(out) > 1:
                out.append(self.boiler(r.choice(("ad", "aside", "share", "form", "notice"))))
        return "\n".join(out) if r.random() < 0.3 else "".join(out)

    def page(self) -> tuple[str, list[tuple[int, str]]]:
        r = self.r
        self.truth: list[tuple[int, str]] = []
        before, after = [], []
        for kind, p in (("notice", 0.25), ("header", 0.5), ("nav", 0.8), ("ad", 0.45), ("form", 0.2), ("aside", 0.2)):
            if r.random() < p:
                before.append(kind)
        for kind, p in (("share", 0.25), ("comments", 0.35), ("aside", 0.4), ("ad", 0.3), ("form", 0.2), ("nav", 0.1), ("footer", 0.8), ("notice", 0.1)):
            if r.random() < p:
                after.append(kind)
        if r.random() < 0.3:
            r.shuffle(before)
        head = "".join(r.choice(("", "<!-- x -->")) + self.boiler(k) for k in before)
        tag = r.choice(("article", "article", "main", "div", "div", "section"))
        plain = tag == "div" and r.random() < 0.3
        body = f"<{tag}{'' if plain or (tag != 'div' and r.random() < 0.6) else self.attrs('main', MAIN)}>{self.article()}</{tag}>"
        if r.random() < 0.3:
            body = f'<div{self.attrs("main", MAIN)}>{body}</div>'
        foot = "".join(self.boiler(k) for k in after)
        end = r.choice(("</body></html>", "</body></html>", ""))
        return f"<!DOCTYPE html><html><head><title>{self.word()}</title><script>var t='</p>';</script></head><body>{head}{body}{foot}{end}", self.truth


def labelled(seed: int, n: int):
    """Pages as blocks with their labels, matched in order."""
    maker, out = Pages(seed), []
    while len(out) < n:
        page, truth = maker.page()
        leaves = blocks(page)
        want = [(y, blocks(f"<p>{t}</p>")) for y, t in truth]
        want = [(y, b[0][1]) for y, b in want if b]
        pool: dict[str, list[int]] = {}
        for y, t in want:
            pool.setdefault(t, []).append(y)
        ys = [pool[t].pop(0) if pool.get(t) else None for _, t, _ in leaves]
        if leaves and None not in ys:
            out.append((leaves, np.array(ys, np.float32)))
    return out


def start(seed: int = 5) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    n = lambda *s, k=0.1: g.standard_normal(s) * k
    b = np.zeros(4 * HIDDEN)
    b[HIDDEN : 2 * HIDDEN] = 1
    return {"path": n(PATHS, INNER, k=0.2), "word": n(WORDS, INNER, k=0.05), "shape": n(SHAPE, INNER, k=0.3), "bias": np.zeros(INNER), "f_x": n(INNER, 4 * HIDDEN, k=0.2), "f_h": n(HIDDEN, 4 * HIDDEN, k=0.2), "f_b": b.copy(), "b_x": n(INNER, 4 * HIDDEN, k=0.2), "b_h": n(HIDDEN, 4 * HIDDEN, k=0.2), "b_b": b.copy(), "out": n(2 * HIDDEN, 1, k=0.3), "out_b": np.zeros(1)}


def _forward(x, mask, wx, wh, b):
    n, steps, _ = x.shape
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    kept, out = [], np.zeros((n, steps, HIDDEN))
    pre = x @ wx + b
    for t in range(steps):
        z = pre[:, t] + h @ wh
        s, g = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN])), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        c2 = f * c + i * g
        tc, m = np.tanh(c2), mask[:, t, None]
        kept.append((h, c, i, f, o, g, tc, m))
        h, c = np.where(m, o * tc, h), np.where(m, c2, c)
        out[:, t] = h
    return out, kept


def _backward(dout, kept, x, wx, wh):
    dx, dwx, dwh, db = np.zeros_like(x), np.zeros_like(wx), np.zeros_like(wh), np.zeros(wx.shape[1])
    dh, dc = np.zeros(dout[:, 0].shape), np.zeros(dout[:, 0].shape)
    for t in range(len(kept) - 1, -1, -1):
        h0, c0, i, f, o, g, tc, m = kept[t]
        dh = dh + dout[:, t]
        dh2, dc2 = np.where(m, dh, 0), np.where(m, dc, 0)
        dc2 = dc2 + dh2 * o * (1 - tc * tc)
        dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c0 * f * (1 - f), dh2 * tc * o * (1 - o), dc2 * i * (1 - g * g)], 1)
        dwx += x[:, t].T @ dz
        dwh += h0.T @ dz
        db += dz.sum(0)
        dx[:, t] = dz @ wx.T
        dh, dc = np.where(m, dz @ wh.T, dh), np.where(m, dc2 * f, dc)
    return dx, dwx, dwh, db


def train(pages, epochs: int = 8, batch: int = 48, rate: float = 0.01, seed: int = 9) -> dict[str, np.ndarray]:
    w = start()
    model = Labeller(w)
    ready = []
    for leaves, y in pages:
        words, shape = model.features(leaves)
        hot = np.zeros((len(leaves), PATHS))
        for k, (e, _, _) in enumerate(leaves):
            hot[k, [bucket(t, PATHS) for t in path(e)]] += 1
        ready.append((hot, words, shape, y))
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    order, g, step = np.argsort([len(p[3]) for p in ready], kind="stable"), np.random.default_rng(seed), 0
    chunks = [order[i : i + batch] for i in range(0, len(order), batch)]
    total = epochs * len(chunks)
    for epoch in range(epochs):
        loss = []
        for k in g.permutation(len(chunks)):
            part = [ready[i] for i in chunks[k]]
            n, steps = len(part), max(len(p[3]) for p in part)
            hot, words, shape, y, mask = (np.zeros((n, steps, d)) for d in (PATHS, WORDS, SHAPE, 1, 1))
            for r, (a, b, c, d) in enumerate(part):
                hot[r, : len(d)], words[r, : len(d)], shape[r, : len(d)], y[r, : len(d), 0], mask[r, : len(d)] = a, b, c, d, 1
            hot *= g.random((n, 1, PATHS)) > 0.1  # whole tokens are left out now and then
            on = mask[..., 0] > 0
            x = np.tanh(hot @ w["path"] + words @ w["word"] + shape @ w["shape"] + w["bias"])
            f, kf = _forward(x, on, w["f_x"], w["f_h"], w["f_b"])
            b, kb = _forward(x[:, ::-1], on[:, ::-1], w["b_x"], w["b_h"], w["b_b"])
            both = np.concatenate([f, b[:, ::-1]], 2)
            p = 1 / (1 + np.exp(-(both @ w["out"] + w["out_b"])))
            loss.append(float(-(np.log(np.where(y > 0, p, 1 - p) + 1e-9) * mask).sum() / mask.sum()))
            d = (p - y) * mask / mask.sum() * 20
            grad = {"out": both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1), "out_b": d.sum((0, 1))}
            db = d @ w["out"].T
            dx1, grad["f_x"], grad["f_h"], grad["f_b"] = _backward(db[..., :HIDDEN], kf, x, w["f_x"], w["f_h"])
            dx2, grad["b_x"], grad["b_h"], grad["b_b"] = _backward(db[:, ::-1, HIDDEN:], kb, x[:, ::-1], w["b_x"], w["b_h"])
            dz = (dx1 + dx2[:, ::-1]) * (1 - x * x)
            flat = dz.reshape(-1, INNER)
            for name, a in (("path", hot), ("word", words), ("shape", shape)):
                grad[name] = a.reshape(-1, a.shape[2]).T @ flat
            grad["bias"] = flat.sum(0)
            step += 1
            lr = rate * (1 - step / (total + 1))
            for name, gr in grad.items():
                gr = np.clip(gr, -5, 5) + 1e-4 * w[name]
                m[name] = 0.9 * m[name] + 0.1 * gr
                v[name] = 0.999 * v[name] + 0.001 * gr * gr
                w[name] = w[name] - lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        print(f"epoch {epoch}: loss {np.mean(loss):.4f}", flush=True)
    return w


def accuracy(w: dict[str, np.ndarray], pages) -> tuple[float, float]:
    """Share of right blocks and of pages with no wrong block."""
    got = Labeller(w).scores([p for p, _ in pages])
    right = [(s >= 0.5) == (y > 0.5) for s, (_, y) in zip(got, pages)]
    return float(np.concatenate(right).mean()), float(np.mean([r.all() for r in right]))


if __name__ == "__main__":
    import os
    import sys

    n = int(sys.argv[1]) if len(sys.argv) > 1 else 8000
    w = train(labelled(11, n))
    print("held out:", accuracy(w, labelled(99, 800)))
    np.savez_compressed(os.path.join(os.path.dirname(__file__), "labeller.npz"), **{k: x.astype(np.float32) for k, x in w.items()})

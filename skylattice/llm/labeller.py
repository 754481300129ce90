"""A bidirectional LSTM that tells a page's main text from the rest, block by block.

It is trained on pages that are drawn here, of many layouts, whose blocks are known.
"""

from __future__ import annotations

import random
import zlib
from functools import lru_cache

import numpy as np

from .blocks import Leaf, leaves

PATH, WORDS, PLAIN, HIDDEN = 160, 32, 8, 24
INPUT = PATH + WORDS + PLAIN
_word_bucket: dict[str, int] = {}
_path_vector: dict[tuple[str, ...], np.ndarray] = {}


def _path(path: tuple[str, ...]) -> np.ndarray:
    if path not in _path_vector:
        if len(_path_vector) > 20_000:
            _path_vector.clear()
        v = np.zeros(PATH, np.float32)
        for depth, element in enumerate(reversed(path)):
            for word in element.split():
                v[zlib.crc32(word.encode()) % PATH] += 1.0 if depth < 2 else 0.7
        _path_vector[path] = np.minimum(v, 2)
    return _path_vector[path]


def vectors(page: list[Leaf], lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Tag-path and hashed-word vectors of a page's blocks lo to hi, and a few plain measures."""
    some = page[lo:hi]
    out = np.zeros((len(some), INPUT), np.float32)
    for i, leaf in enumerate(some):
        words = leaf.text.split(" ")
        if len(_word_bucket) > 200_000:
            _word_bucket.clear()
        at = []
        for w in words:
            b = _word_bucket.get(w)
            if b is None:
                b = _word_bucket[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS
            at.append(b)
        out[i, :PATH] = _path(leaf.path)
        out[i, PATH : PATH + WORDS] = np.bincount(at, minlength=WORDS) / np.sqrt(len(words))
        n = len(leaf.text)
        out[i, PATH + WORDS :] = [
            np.log1p(len(words)) / 4, np.log1p(n) / 6, min(1, leaf.linked / n), leaf.text[-1] in ".!?…", leaf.text.count(",") * 8 / n, len(leaf.path) / 8, (lo + i) / len(page), np.log1p(len(page)) / 5,
        ]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Parameters, forward pass and gradients; a batch is padded and masked."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for way in "fb":
            self.p[f"x{way}"], self.p[f"h{way}"] = draw(INPUT, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN)
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p[f"c{way}"] = bias
        self.p["o"], self.p["ob"] = draw(2 * HIDDEN, 1), np.zeros(1, np.float32)

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None, state: list | None = None) -> np.ndarray:
        """Hidden states along time; a padded step carries the state on. `state` (h, c) is where to begin, and is set to where it ends."""
        n, length, _ = x.shape
        pre = x @ self.p[f"x{way}"] + self.p[f"c{way}"]
        h, c = state or (np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32))
        out = np.zeros((n, length, HIDDEN), np.float32)
        for t in range(length) if way == "f" else range(length - 1, -1, -1):
            z = pre[:, t] + h @ self.p[f"h{way}"]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = mask[:, t, None]
            c2 = f * c + i * g
            s = np.tanh(c2)
            if keep is not None:
                keep.append((t, i, f, o, g, c, h, s, on))
            c, h = np.where(on, c2, c), np.where(on, o * s, h)
            out[:, t] = h
        if state is not None:
            state[:] = h, c
        return out

    def margins(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return (np.concatenate([self._run("f", x, mask, None), self._run("b", x, mask, None)], axis=2) @ self.p["o"] + self.p["ob"])[..., 0]

    def margins_of_long(self, page: list[Leaf], part: int) -> np.ndarray:
        """Margins of one page's blocks, whose vectors are made and read a part at a time, on and back; the states go through all of it."""
        n = len(page)
        hidden, starts = np.zeros((n, 2 * HIDDEN), np.float32), list(range(0, n, part))
        for k, way in enumerate("fb"):
            state = [np.zeros((1, HIDDEN), np.float32), np.zeros((1, HIDDEN), np.float32)]
            for lo in starts if way == "f" else starts[::-1]:
                x = vectors(page, lo, lo + part)[None]
                hidden[lo : lo + part, k * HIDDEN : (k + 1) * HIDDEN] = self._run(way, x, np.ones(x.shape[:2], bool), None, state)[0]
        return (hidden @ self.p["o"] + self.p["ob"])[:, 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        steps: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(w, x, mask, steps[w]) for w in "fb"], axis=2)
        p = _sigmoid((states @ self.p["o"] + self.p["ob"])[..., 0])
        total = mask.sum()
        loss = -float((np.where(y, np.log(p + 1e-7), np.log(1 - p + 1e-7)) * mask).sum() / total)
        d = ((p - y) * mask / total).astype(np.float32)[..., None]
        grad = {"o": states.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1), "ob": d.sum(axis=(0, 1))}
        d_states = d @ self.p["o"].T
        for k, way in enumerate("fb"):
            d_pre = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            g_h = np.zeros_like(self.p[f"h{way}"])
            d_h, d_c = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for t, i, f, o, g, c, h, s, on in reversed(steps[way]):
                d_h = d_h + d_states[:, t, k * HIDDEN : (k + 1) * HIDDEN]
                d_s = np.where(on, d_h, 0)
                d_c2 = np.where(on, d_c, 0) + d_s * o * (1 - s * s)
                z = np.concatenate([d_c2 * g * i * (1 - i), d_c2 * c * f * (1 - f), d_s * s * o * (1 - o), d_c2 * i * (1 - g * g)], axis=1)
                d_pre[:, t] = z
                g_h += h.T @ z
                d_h, d_c = np.where(on, 0, d_h) + z @ self.p[f"h{way}"].T, np.where(on, d_c2 * f, d_c)
            grad[f"x{way}"] = x.reshape(-1, INPUT).T @ d_pre.reshape(-1, 4 * HIDDEN)
            grad[f"h{way}"], grad[f"c{way}"] = g_h, d_pre.sum(axis=(0, 1))
        return loss, grad


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((len(pages), longest, INPUT), np.float32), np.zeros((len(pages), longest), bool)
    for k, v in enumerate(pages):
        x[k, : len(v)], mask[k, : len(v)] = v, True
    return x, mask


def label(model: Labeller, pages: list[list[Leaf]], chunk: int = 4096) -> list[np.ndarray]:
    """True for the main blocks of each page. Pages of like length run together; one that is longer
    than `chunk` blocks runs alone, still as one sequence, but never as one array of vectors."""
    out = [np.zeros(len(p), bool) for p in pages]
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    lo = 0
    while lo < len(order):
        if len(pages[order[lo]]) > chunk:
            out[order[lo]] = model.margins_of_long(pages[order[lo]], chunk) > 0
            lo += 1
            continue
        hi = lo + 1
        while hi < len(order) and (hi - lo + 1) * len(pages[order[hi]]) <= chunk:
            hi += 1
        x, mask = padded([vectors(pages[k]) for k in order[lo:hi]])
        m = model.margins(x, mask)
        for row, k in zip(m, order[lo:hi], strict=True):
            out[k] = row[: len(pages[k])] > 0
        lo = hi
    return out


# -- pages to learn from ------------------------------------------------------

#: What pages call their parts (fixed values).
_MENU = "nav menu navbar navigation topnav breadcrumb breadcrumbs links toc pagination tabs".split()
_SIDE = "sidebar side aside related widget rail recommended trending popular more-stories".split()
_TOP = "header masthead top topbar site-header branding banner-top logo".split()
_BOTTOM = "footer bottom site-footer copyright legal colophon".split()
_AD = "ad ads advert advertisement sponsor sponsored promo ad-slot banner-ad adsbox".split()
_NOTICE = "notice cookie cookie-banner consent alert banner gdpr popup modal newsletter-notice disclaimer".split()
_TALK = "comments comment comment-list replies reply discussion responses disqus".split()
_FORM = "search subscribe newsletter login signup contact form search-form".split()
_MAIN = "content article post entry story main body text article-body post-content entry-content main-content".split()
_SHARE = "share social sharing tags meta byline-tools print".split()


#: Private-use marks of where a drawn block comes from.
GOOD, BAD = "\ue001", "\ue000"


class _Author:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        bits = "the an er on re th in ou le de en ch sch ung que os ci ar ment tion ha st ly é ö ñ ção ž".split()
        self.words = ["".join(self.r.choices(bits, k=self.r.randint(1, 4))) for _ in range(500)]
        #: a page of bare divisions or table cells, which tell by their content alone; and what its paragraphs are
        self.bare, self.leaf = False, "p"

    def say(self, lo: int, hi: int, stop: bool = True) -> str:
        n = self.r.randint(lo, hi)
        words = self.r.choices(self.words, k=n)
        style = self.r.random()
        if style < 0.12:
            words = [w + self.r.choice(["***", "###", "$$$", "%%%", "&amp;&amp;&amp;"]) for w in words]
        elif style < 0.2:
            words = [w.upper() + "!!" for w in words]
        elif style < 0.25 and n > 4:  # lists and refrains are prose too
            words = [w + self.r.choice([" |", " |", ""]) for w in words]
        elif style < 0.33 and n > 4:
            words = [w for w in words[: max(1, n // 8)] for _ in range(self.r.randint(4, 12))]
        text = " ".join(w + ("," if self.r.random() < 0.08 else "") for w in words)
        return text[:1].upper() + text[1:] + ("." if stop else "")

    def named(self, names: list[str], tags: str) -> tuple[str, str]:
        tag, name, r = self.r.choice(tags.split()), self.r.choice(names), self.r.random()
        if self.bare:
            return "<div>", "</div>"
        plain = tag not in ("div", "section", "ul", "ol", "p", "span") and r < 0.6
        attr = "" if plain else f' id="{name}"' if r < 0.25 else f' class="{name}"' if r < 0.8 else f' class="{name} {self.r.choice(self.words)}"'
        return f"<{tag}{attr}>", f"</{tag}>"

    def links(self) -> list[str]:
        n = self.r.randint(2, 9)
        items = [f'<a href="/{self.r.choice(self.words)}">{self.say(1, 3, False)}</a>' for _ in range(n)]
        if self.bare and self.r.random() < 0.6:
            return [self.r.choice([" | ", " ", " · ", "<br>"]).join(items if self.r.random() < 0.7 else [self.say(1, 2, False) for _ in items])]
        return ["<ul>", *(f"<li>{i}</li>" for i in items), "</ul>"] if self.r.random() < 0.7 else items if self.r.random() < 0.5 else [f"<p>{' '.join(items)}</p>"]

    def prose(self, n: int) -> list[str]:
        out = []
        for _ in range(n):
            r, long_ = self.r.random(), self.r.choice([30, 60, 140] if self.bare else [3, 12, 60, 140])
            if r < (0.85 if self.bare else 0.72):
                text = self.say(7 if self.bare else 1, long_, self.r.random() < 0.8)
                if self.r.random() < 0.2:
                    text = f"<b>{text}<br>" if self.r.random() < 0.5 else f"<em>{text}</em>"
                if self.r.random() < 0.1:
                    text += f' <a href="#">{self.say(1, 4, False)}</a>'
                out.append(f"<div>{text}</div>" if self.leaf == "div" else f"<p>{text}" + ("</p>" if self.r.random() < 0.8 else ""))
            elif r < (0.93 if self.bare else 0.8):
                out.append(f"<h{self.r.randint(2, 4)}>{self.say(1, 7, False)}</h3>")
            elif r < 0.87:
                out += ["<ul>" if self.r.random() < 0.5 else "<ol>", *(f"<li>{self.say(2, 15)}</li>" for _ in range(self.r.randint(2, 5))), "</ul></ol>"]
            elif r < 0.92:
                out.append(f"<blockquote>{self.say(5, 40)}</blockquote>")
            elif r < 0.95:
                out.append(f"<pre>{self.say(3, 20, False)}</pre>")
            elif r < 0.98:
                out += ["<table>", *(f"<tr><td>{self.say(1, 3, False)}</td><td>{self.say(1, 5, False)}</td></tr>" for _ in range(3)), "</table>"]
            else:
                out.append(f"<figure><figcaption>{self.say(3, 12)}</figcaption></figure>")
        return out

    def other(self, kind: str) -> list[str]:
        r = self.r
        if kind == "menu":
            a, b = self.named(_MENU, "nav nav nav div ul")
            return [a, *self.links(), b]
        if kind == "top":
            a, b = self.named(_TOP, "header header div")
            return [a, *([f"<h{r.randint(1, 2)}>{self.say(1, 4, False)}</h1>"] if r.random() < 0.6 else []), *([f"<p>{self.say(2, 8)}</p>"] if r.random() < 0.5 else []), *(self.other("menu") if r.random() < 0.4 else []), b]
        if kind == "bottom":
            a, b = self.named(_BOTTOM, "footer footer footer div")
            if self.bare:
                sign = r.choice(["&copy; ", "&copy; 2024 ", "Copyright 2023 ", "(c) 2019 "])
                lines = [[sign + self.say(1, 5, r.random() < 0.3)], self.links(), [sign + self.say(1, 3, False) + " | " + " | ".join(self.say(1, 2, False) for _ in range(r.randint(1, 4)))]]
                return [a, *r.choice(lines), b]
            inner = [f"&copy; {r.choice(self.words)}.example.com &middot; {self.say(2, 14)}"] if r.random() < 0.6 else [f"<p>{self.say(2, 16)}</p>"]
            return [a, *inner, *(self.links() if r.random() < 0.3 else []), b]
        if kind == "ad":
            a, b = self.named(_AD, "div div aside section p")
            return [a, self.say(2, 20) if r.random() < 0.6 else f"<p>{self.say(2, 25)}</p>", b]
        if kind == "side":
            a, b = self.named(_SIDE, "aside aside div section")
            return [a, f"<h3>{self.say(1, 4, False)}</h3>", *(self.links() if r.random() < 0.6 else [f"<p>{self.say(3, 50)}</p>" for _ in range(r.randint(1, 3))]), b]
        if kind == "notice":
            a, b = self.named(_NOTICE, "div div section p")
            return [a.replace(">", ' role="alert">') if r.random() < 0.3 else a, f"{self.say(3, 40)}" if r.random() < 0.5 else f"<p>{self.say(3, 40)}</p>", *(["<button>" + self.say(1, 2, False) + "</button>"] if r.random() < 0.5 else []), b]
        if kind == "form":
            a, b = ("<form>", "</form>") if r.random() < 0.7 else self.named(_FORM, "div section form")
            return [a, f"<label>{self.say(1, 4, False)}</label><input>", f"<select><option>{self.say(1, 2, False)}<option>{self.say(1, 2, False)}</select>" if r.random() < 0.4 else "", f"<p>{self.say(3, 20)}</p>" if r.random() < 0.4 else "", f"<button>{self.say(1, 2, False)}</button>", b]
        if kind == "hidden":
            tag, how = r.choice("div div p section span ul".split()), r.choice(["hidden", 'style="display:none"', 'style="color:red; visibility: hidden"', 'class="x" hidden'])
            return [f"<{tag} {how}>", self.say(2, 40) if r.random() < 0.5 or tag == "span" else f"<p>{self.say(2, 60)}</p>", f"</{tag}>"]
        if kind == "share":
            a, b = self.named(_SHARE, "div div ul p")
            return [a, *self.links(), b]
        a, b = self.named(_TALK, "section div div ol")
        inner = []
        for _ in range(r.randint(1, 5)):
            c, d = self.named(_TALK[:1] + _TALK[4:6] + ["comment"], "div article li div")
            inner += [c, f"<p>{self.say(1, 3, False)}</p>" if r.random() < 0.4 else "", f"<p>{self.say(3, 60)}</p>", d]
        return [a, f"<h2>{self.say(1, 3, False)}</h2>" if r.random() < 0.5 else "", *inner, b]

    def page(self) -> tuple[list[Leaf], list[bool]]:
        """The blocks of a page, still marked, and the label of each of its blocks."""
        r = self.r
        pieces: list[tuple[list[str], bool]] = []
        self.bare = r.random() < 0.25
        self.leaf = r.choice(["div", "div", "p"]) if self.bare else "p"
        cells = self.bare and r.random() < 0.4
        some = lambda kinds, p: [(self.other(k), False) for k in kinds if r.random() < p]
        front = some(["notice"], 0.25) + some(["top"], 0.4) + some(["menu"], 0.75) + some(["ad"], 0.45) + some(["form", "side"], 0.12)
        if self.bare:
            front = some(["top"], 0.3) + some(["menu"], 0.85)
        if r.random() < 0.5:
            r.shuffle(front)
        if cells:
            front = [(["<table><tr>"], False), *((["<td>", *lines, "</td>"], False) for lines, _ in front), (["</tr><tr><td>"] if r.random() < 0.5 else ["<td>"], False)]
        pieces += front
        a, b = self.named(_MAIN, "article article article main div div section")
        if r.random() < 0.2:
            a, b = f"<main>{a}", f"{b}</main>"
        title = [f"<h1>{self.say(1, 12, r.random() < 0.5)}</h1>"] if r.random() < 0.85 else []
        body = [*title, *self.prose(r.randint(1, 12))]
        pieces.append(([a], True))
        at = 0
        while at < len(body):
            n = r.randint(2, 12)
            pieces.append((body[at : at + n], True))
            at += n
            if at < len(body) and r.random() < 0.5 and not self.bare:
                pieces += [(self.other(r.choice(["ad", "ad", "share", "form", "notice", "side", "hidden"])), False)]
        pieces.append(([b], True))
        back = some(["share"], 0.2) + some(["talk"], 0.4) + some(["side"], 0.4) + some(["ad", "form"], 0.25) + some(["bottom"], 0.8) + some(["hidden"], 0.1)
        if self.bare:
            back = some(["share"], 0.15) + some(["bottom"], 0.85)
            if cells:
                back = [(["</td></tr>"], False), *((["<tr><td>", *lines, "</td></tr>"], False) for lines, _ in back), (["</table>"], False)]
            pieces += back
        else:
            pieces += back + some(["notice"], 0.1)
        html = ""
        for lines, good in pieces:
            # marks tell later which piece a block came from; they are taken out before learning
            html += "".join(_marked(line, good) for line in lines)
        found = leaves(f"<!DOCTYPE html><html><head><title>x</title></head><body>{html}</body></html>")
        return found, [GOOD in leaf.text for leaf in found]


def _marked(line: str, good: bool) -> str:
    """The line with a mark at the head of each run of text."""
    out, inside = [], False
    fresh = True
    for ch in line:
        if ch == "<":
            inside = fresh = True
        elif ch == ">" and inside:
            inside = False
        elif not inside and fresh and not ch.isspace():
            out.append(GOOD if good else BAD)
            fresh = False
        out.append(ch)
    return "".join(out)


@lru_cache(maxsize=2)
def trained(pages: int = 1200, rounds: int = 6, seed: int = 13) -> Labeller:
    """The labeller after a few rounds of Adam over drawn pages, the same parameters give the same weights."""
    author = _Author(seed)
    data = []
    for _ in range(pages):
        found, good = author.page()
        clean = [Leaf(x.path, x.text.replace(GOOD, "").replace(BAD, ""), x.linked) for x in found]
        keep = [k for k, x in enumerate(clean) if x.text]
        if keep:
            data.append((vectors([clean[k] for k in keep]), np.array([good[k] for k in keep])))
    model, rng = Labeller(), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for round_ in range(rounds):
        order = sorted(rng.permutation(len(data)), key=lambda k: len(data[k][0]) // 8)
        batches = [order[i : i + 32] for i in range(0, len(order), 32)]
        for b in rng.permutation(len(batches)):
            x, mask = padded([data[k][0] for k in batches[b]])
            y = np.zeros(mask.shape, bool)
            for row, k in enumerate(batches[b]):
                y[row, : len(data[k][1])] = data[k][1]
            _, grad = model.gradients(x, mask, y)
            step += 1
            rate = 0.01 * (1 if round_ < rounds - 2 else 0.3)
            for name, g in grad.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                model.p[name] = (model.p[name] - rate * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model

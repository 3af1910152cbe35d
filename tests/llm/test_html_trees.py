"""Random pages whose visible words are known from how they are made."""

import random

import pytest

from orrery.llm.html_text import visible_text

BLOCKS, INLINE = ["div", "p", "section", "blockquote", "h2", "li", "article", "dd"], ["b", "i", "span", "a", "em", "code"]
HIDING = ["<script>{}</script>", "<style>{}</style>", "<!-- {} -->", "<template>{}</template>", "<div hidden>{}</div>", "<span style='display: none'>{}</span>", "<noscript>{}</noscript>", "<svg><desc>{}</desc></svg>", "<input type=hidden value='{}'>", "<progress>{}</progress>", "<meter>{}</meter>", "<!--> <!--{}-->", "<![CDATA[{}]]>"]
SHOWING = ["<svg><text>{}</text></svg>", "<math><mi>{}</mi></math>", "<textarea>{}</textarea>", "<select><option>{}</select>", "<input value='{}'>", "<table><tr><td>{}</table>", "<ul><li>{}</ul>", "<pre>{}</pre>", "<details open><summary>{}</summary></details>", "<svg><foreignObject><p>{}</p></foreignObject></svg>", "<map>{}</map>", "<!-->{}", "<!--->{}", "<svg><text><![CDATA[{}]]></text></svg>", "<math><ms><svg><text><![CDATA[{}]]></text></svg></ms></math>"]


class Maker:
    def __init__(self, seed):
        self.rng, self.words, self.n = random.Random(seed), [], 0

    def word(self, seen):
        self.n += 1
        if seen:
            self.words.append(f"w{self.n}")
        return f" w{self.n} "

    def part(self, depth, visible):
        """Html of one part; `visible` is the inherited visibility."""
        r = self.rng.random()
        if depth == 0 or r < 0.3:
            return self.word(visible)
        if r < 0.45:
            return self.rng.choice(HIDING).format(self.word(False))
        if r < 0.6:
            return self.rng.choice(SHOWING).format(self.word(visible))
        if r < 0.7:
            now = self.rng.random() < 0.5
            return f"<div style='visibility:{'visible' if now else 'hidden'}'>{self.parts(depth, now)}</div>"
        name = self.rng.choice(INLINE if r < 0.85 else BLOCKS)
        if name == "li":
            return f"<div>{self.parts(depth, visible)}</div>"
        if name == "dd":  # without a list of its own it would end an outer one
            return f"<dl><dd>{self.parts(depth, visible)}</dl>"
        body = self.word(visible) if name == "p" else self.parts(depth, visible)  # a block inside would end the p
        return f"<{name} title='a > b'>{body}" + ("" if name == "p" and self.rng.random() < 0.5 else f"</{name}>")

    def parts(self, depth, visible):
        return "".join(self.part(depth - 1, visible) for _ in range(self.rng.randint(1, 4)))


@pytest.mark.parametrize("seed", range(150))
def test_words_in_order(seed):
    maker = Maker(seed)
    html = "".join(f"<div>{maker.parts(5, True)}</div>" for _ in range(4))
    assert [w for w in visible_text(html).split() if w != "-"] == maker.words


@pytest.mark.parametrize("html, text", [
    ("<!-->Hello<p>x", "Hello\n\nx"),
    ("<!--->Hello<p>x", "Hello\n\nx"),
    ("a<!-- - -- > -->b<!-- c", "ab"),
    ("<svg><text><![CDATA[a < b & c > d]]>e</text></svg>f", "a < b & c > de\nf"),
    ("<svg><foreignObject><![CDATA[x>y]]></foreignObject></svg>", "y]]>"),
    ("<svg><text><![CDATA[open", "open"),
    ("<progress>50%</progress>a", "a"),
    ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"),
    ("<ol reversed start=10><li>a<li value=4>b<li>c</ol>", "10. a\n4. b\n3. c"),
    ("<ol type=a start=26><li>x<li>y</ol>", "z. x\naa. y"),
    ("<ol type=I start=48><li>x<li>y<li type=1>z</ol>", "XLVIII. x\nXLIX. y\n50. z"),
    ("<ol type=A start=-1><li>x<li>y<li>z</ol>", "-1. x\n0. y\nA. z"),
    ("<ol><li>a<ol type=i><li>b<li>c</ol><li>d</ol>", "1. a\n   i. b\n   ii. c\n2. d"),
    ("<ol start=+3><li>a</ol><ul><li>b</ul>", "3. a\n\n- b"),
])
def test_comments_and_numbers(html, text):
    assert visible_text(html) == text

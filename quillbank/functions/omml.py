"""Office math markup as LaTeX."""

from __future__ import annotations

from xml.etree.ElementTree import Element

M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: LaTeX commands of characters.
COMMANDS = {
    "×": r"\times", "÷": r"\div", "±": r"\pm", "∓": r"\mp", "·": r"\cdot", "≤": r"\le", "≥": r"\ge", "≠": r"\ne", "≈": r"\approx", "≡": r"\equiv",
    "∞": r"\infty", "∈": r"\in", "∉": r"\notin", "⊂": r"\subset", "⊆": r"\subseteq", "∪": r"\cup", "∩": r"\cap", "∅": r"\varnothing", "∀": r"\forall", "∃": r"\exists",
    "→": r"\to", "←": r"\leftarrow", "⇒": r"\Rightarrow", "⇔": r"\Leftrightarrow", "∂": r"\partial", "∇": r"\nabla", "∠": r"\angle", "△": r"\triangle", "⊥": r"\perp", "∥": r"\parallel",
    "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\varepsilon", "ζ": r"\zeta", "η": r"\eta", "θ": r"\theta", "λ": r"\lambda", "μ": r"\mu",
    "ξ": r"\xi", "π": r"\pi", "ρ": r"\rho", "σ": r"\sigma", "τ": r"\tau", "φ": r"\varphi", "χ": r"\chi", "ψ": r"\psi", "ω": r"\omega",
    "Γ": r"\Gamma", "Δ": r"\Delta", "Θ": r"\Theta", "Λ": r"\Lambda", "Π": r"\Pi", "Σ": r"\Sigma", "Φ": r"\Phi", "Ψ": r"\Psi", "Ω": r"\Omega",
}
NARY = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∬": r"\iint", "∭": r"\iiint", "∮": r"\oint", "⋃": r"\bigcup", "⋂": r"\bigcap", "": r"\int"}
ACCENTS = {"̂": r"\hat", "̃": r"\tilde", "̄": r"\bar", "⃗": r"\vec", "̇": r"\dot", "̈": r"\ddot", "̅": r"\overline", "": r"\hat"}
_SPECIAL = {"\\": r"\backslash ", "{": r"\{", "}": r"\}", "%": r"\%", "#": r"\#", "&": r"\&", "$": r"\$", "_": r"\_", "^": r"\hat{}", "~": r"\sim "}
_FUNCTIONS = {"sin", "cos", "tan", "cot", "sec", "csc", "log", "ln", "lg", "lim", "max", "min", "exp", "sinh", "cosh", "tanh", "arcsin", "arccos", "arctan"}
_FENCES = {"{": r"\{", "}": r"\}", "〈": r"\langle", "〉": r"\rangle", "⟨": r"\langle", "⟩": r"\rangle", "‖": r"\Vert", "": "."}
_LIMIT = 200


def text_latex(text: str) -> str:
    """Characters of a run."""
    return "".join(f"{COMMANDS[c]} " if c in COMMANDS else _SPECIAL.get(c, c) for c in text)


def _property(node: Element, name: str, otherwise: str | None = None) -> str | None:
    found = node.find(f"{M}{node.tag.removeprefix(M)}Pr/{M}{name}")
    return otherwise if found is None else found.get(f"{M}val", "")


def _on(node: Element, name: str) -> bool:
    return _property(node, name, "0") in ("", "1", "on", "true")


class _Writer:
    def __init__(self):
        self.whole = True

    def child(self, node: Element, name: str, depth: int) -> str:
        found = node.find(f"{M}{name}")
        return "" if found is None else self.all(found, depth).strip()

    def all(self, node: Element, depth: int) -> str:
        return "".join(self.one(x, depth + 1) for x in node)

    def one(self, node: Element, depth: int) -> str:
        if depth > _LIMIT:
            self.whole = False
            return ""
        if not node.tag.startswith(M):
            return ""
        name = node.tag.removeprefix(M)
        part = lambda key: self.child(node, key, depth)
        match name:
            case "r":
                text = "".join(t.text or "" for t in node.iter(f"{M}t"))
                upright = node.find(f"{M}rPr/{M}nor") is not None
                return rf"\text{{{text}}}" if upright and text.strip() else text_latex(text)
            case "f":
                top, below = part("num"), part("den")
                kind = _property(node, "type", "bar")
                self.whole = self.whole and kind in ("bar", "noBar", "lin", "skw")
                shapes = {"bar": rf"\frac{{{top}}}{{{below}}}", "noBar": rf"\genfrac{{}}{{}}{{0pt}}{{}}{{{top}}}{{{below}}}"}
                return shapes.get(kind, f"{{{top}}}/{{{below}}}" if kind in ("lin", "skw") else "")
            case "sSup" | "sSub" | "sSubSup":
                base = part("e")
                marks = [f"{mark}{{{part(key)}}}" for key, mark in (("sub", "_"), ("sup", "^")) if name != ("sSup" if key == "sub" else "sSub")]
                return "".join([base if len(base) == 1 else f"{{{base}}}", *marks])
            case "sPre":
                return f"{{}}_{{{part('sub')}}}^{{{part('sup')}}}{{{part('e')}}}"
            case "rad":
                degree = "" if _on(node, "degHide") else part("deg")
                return rf"\sqrt[{degree}]{{{part('e')}}}" if degree else rf"\sqrt{{{part('e')}}}"
            case "nary":
                out = NARY.get(_property(node, "chr", "∫"), text_latex(_property(node, "chr", "")))
                for key, mark in (("sub", "_"), ("sup", "^")):
                    bound = part(key)
                    out += f"{mark}{{{bound}}}" if bound else ""
                return f"{out} {part('e')}"
            case "d":
                fence = lambda key, c: _FENCES.get(_property(node, key, c), _property(node, key, c))
                inner = text_latex(_property(node, "sepChr", "|")).join(self.all(e, depth).strip() for e in node.findall(f"{M}e"))
                return rf"\left{fence('begChr', '(')} {inner}\right{fence('endChr', ')')} "
            case "func":
                called = part("fName")
                return f"{chr(92)}{called} {part('e')}" if called in _FUNCTIONS else rf"{called} {part('e')}"
            case "acc":
                return f"{ACCENTS.get(_property(node, 'chr', chr(0x302)), chr(92) + 'hat')}{{{part('e')}}}"
            case "bar":
                return rf"\underline{{{part('e')}}}" if _property(node, "pos", "bot") == "bot" else rf"\overline{{{part('e')}}}"
            case "groupChr":
                return rf"\overbrace{{{part('e')}}}" if _property(node, "pos", "bot") == "top" else rf"\underbrace{{{part('e')}}}"
            case "limLow":
                base = part("e")
                return f"{chr(92)}{base}_{{{part('lim')}}}" if base in ("lim", "max", "min") else rf"\underset{{{part('lim')}}}{{{base}}}"
            case "limUpp":
                return rf"\overset{{{part('lim')}}}{{{part('e')}}}"
            case "m":
                rows = [" & ".join(self.all(e, depth).strip() for e in row.findall(f"{M}e")) for row in node.findall(f"{M}mr")]
                return rf"\begin{{matrix}}{r' \\ '.join(rows)}\end{{matrix}}"
            case "eqArr":
                return rf"\begin{{aligned}}{r' \\ '.join(self.all(e, depth).strip() for e in node.findall(f'{M}e'))}\end{{aligned}}"
            case "box" | "borderBox" | "phant":
                inner = part("e")
                return rf"\boxed{{{inner}}}" if name == "borderBox" else rf"\phantom{{{inner}}}" if name == "phant" and _property(node, "show", "1") in ("0", "off", "false") else inner
            case "oMath" | "oMathPara" | "e":
                return self.all(node, depth)
        if not name.endswith("Pr"):
            self.whole = False
        return ""


def latex(node: Element) -> tuple[str, bool]:
    """LaTeX of an oMath element, and whether everything in it was understood."""
    writer = _Writer()
    out = writer.all(node, 0).strip()
    return " ".join(out.split()), writer.whole

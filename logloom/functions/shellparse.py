"""One parse of a shell command, with everything the detector language asks of it.

A single pass over the characters yields tokens; here-documents are taken out as their operator is met,
substitutions become one placeholder word. Tokens are then folded into pipelines of segments. The parse is
partial on purpose: what cannot be followed is marked unsure and never guessed. It runs as one Arrow UDF;
every derived array is computed here, so that predicates over it stay inside the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Longer commands are not parsed.
MAX_COMMAND = 16 * 1024
SUBSTITUTION = "\ue000sub\ue001"
HEREDOC = "\ue000doc{}\ue001"
_UNRESOLVED = re.compile("[$`\ue000]")  # what the parse could not resolve

# Operators, reserved words and options that take a value.
OPERATORS = ("<<<", "<<-", "&>>", "&&", "||", ";;", "|&", "<<", ">>", "<&", ">&", "&>", ">|", ";", "&", "|", "<", ">", "(", ")")
REDIRECTS = frozenset(("<<<", "<<-", "&>>", "<<", ">>", "<&", ">&", "&>", ">|", "<", ">"))
SEPARATORS = frozenset((";", "&&", "||", "&", ";;"))
RESERVED = frozenset("do done then fi else esac ! while until if elif for select case in".split())
CONSTRUCT_ENDS = frozenset("then else elif fi do done esac".split())
GIT_VALUED = frozenset("-C -c --git-dir --work-tree --namespace --super-prefix --config-env --attr-source".split())
VALUED_FLAGS = frozenset("--cwd -C --prefix --dir -f --file".split())
GIT_SHORT_ALONE = frozenset("aeinopqsvz")
_ASSIGNMENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*=")


class Unparsable(ValueError):
    pass


@dataclass
class Token:
    text: str
    operator: bool = False
    quoted: bool = False


class _Reader:
    """Characters to tokens."""

    def __init__(self, text: str):
        self.text = re.sub(r"\\\n[ \t]*", " ", text.replace("\r\n", "\n").replace("\r", "\n"))
        self.at = 0
        self.bodies: list[str] = []
        self.waiting: list[tuple[str, bool, int]] = []

    def tokens(self) -> list[Token]:
        out: list[Token] = []
        word: list[str] = []
        started = quoted = False

        def end_word():
            nonlocal started, quoted
            if started:
                out.append(Token("".join(word), quoted=quoted))
            word.clear()
            started = quoted = False

        t = self.text
        while self.at < len(t):
            c = t[self.at]
            if c == "\n":
                end_word()
                self.at += 1
                self._take_bodies()
                out.append(Token(";", operator=True))
            elif c in " \t":
                end_word()
                self.at += 1
            elif c == "#" and not started:
                nl = t.find("\n", self.at)
                self.at = len(t) if nl < 0 else nl
            elif c == "'":
                close = t.find("'", self.at + 1)
                if close < 0:
                    raise Unparsable
                word.append(t[self.at + 1 : close])
                started = quoted = True
                self.at = close + 1
            elif c == '"':
                word.append(self._double())
                started = quoted = True
            elif c == "\\":
                word.append(t[self.at + 1 : self.at + 2])
                started = quoted = True
                self.at += 2
            elif (sub := self._substitution()) is not None:
                word.append(sub)
                started = True
            elif op := next((o for o in OPERATORS if t.startswith(o, self.at)), None):
                end_word()
                self.at += len(op)
                out.append(Token("<<" if op == "<<-" else op, operator=True))
                if op in ("<<", "<<-"):
                    out.append(self._delimiter(op == "<<-"))
            else:
                word.append(c)
                started = True
                self.at += 1
        end_word()
        self._take_bodies()
        return out

    def _double(self) -> str:
        t, out = self.text, []
        self.at += 1
        while self.at < len(t):
            c = t[self.at]
            if c == '"':
                self.at += 1
                return "".join(out)
            if c == "\\" and t[self.at + 1 : self.at + 2] in ('"', "\\", "$", "`"):
                out.append(t[self.at + 1])
                self.at += 2
            elif c in "$`" and (sub := self._substitution()) is not None:
                out.append(sub)
            else:
                out.append(c)
                self.at += 1
        raise Unparsable

    def _substitution(self) -> str | None:
        """The placeholder of a substitution that begins here; a here-document alone in ``$(cat ...)`` stands for itself."""
        t = self.text
        if t[self.at] == "`":
            i = self.at + 1
            while i < len(t) and t[i] != "`":
                i += 2 if t[i] == "\\" else 1
            if i >= len(t):
                raise Unparsable
            self.at = i + 1
            return SUBSTITUTION
        if not (t.startswith("$(", self.at) or (t[self.at] in "<>" and t.startswith("(", self.at + 1))):
            return None
        inner = _Reader("")
        inner.text, inner.at = t, self.at + 2
        found = inner._until_paren()
        self.at = inner.at
        alone = len(found) == 3 and found[0].text == "cat" and found[1].text == "<<" and found[1].operator
        first = len(self.bodies)
        self.bodies += inner.bodies
        return HEREDOC.format(first) if alone and len(inner.bodies) == 1 else SUBSTITUTION

    def _until_paren(self) -> list[Token]:
        """The tokens up to the parenthesis that closes this substitution."""
        t, depth, out, word = self.text, 0, [], []
        while self.at < len(t):
            c = t[self.at]
            if c == ")" and depth == 0:
                self.at += 1
                if word:
                    out.append(Token("".join(word)))
                return [x for x in out if x.text != "\n"]
            if c in " \t\n" or (c in "<();|&>" and not (c in "<>" and t.startswith("(", self.at + 1))):
                if word:
                    out.append(Token("".join(word)))
                    word = []
                depth += (c == "(") - (c == ")")
                if t.startswith("<<", self.at) and not t.startswith("<<<", self.at):
                    dash = t.startswith("<<-", self.at)
                    self.at += 3 if dash else 2
                    out += [Token("<<", operator=True), self._delimiter(dash)]
                    continue
                self.at += 3 if t.startswith("<<<", self.at) else 1
                if c == "\n":
                    self._take_bodies()
                elif c not in " \t":
                    out.append(Token(c, operator=True))
            elif c == "'":
                close = t.find("'", self.at + 1)
                if close < 0:
                    raise Unparsable
                word.append(t[self.at : close + 1])
                self.at = close + 1
            elif c == '"':
                word.append('"' + self._double())
            elif c == "\\":
                word.append(t[self.at : self.at + 2])
                self.at += 2
            elif (sub := self._substitution()) is not None:
                word.append(sub)
            else:
                word.append(c)
                self.at += 1
        raise Unparsable

    def _delimiter(self, dash: bool) -> Token:
        t = self.text
        while t[self.at : self.at + 1] in (" ", "\t"):
            self.at += 1
        word, start = [], self.at
        while self.at < len(t):
            c = t[self.at]
            if c in "'\"":
                close = t.find(c, self.at + 1)
                if close < 0:
                    raise Unparsable
                word.append(t[self.at + 1 : close])
                self.at = close + 1
            elif c == "\\":
                word.append(t[self.at + 1 : self.at + 2])
                self.at += 2
            elif c.isalnum() or c in "_-.":
                word.append(c)
                self.at += 1
            else:
                break
        if self.at == start:
            return Token("", quoted=True)
        number = len(self.bodies)
        self.bodies.append("")
        self.waiting.append(("".join(word), dash, number))
        return Token(HEREDOC.format(number), quoted=True)

    def _take_bodies(self) -> None:
        """The bodies of the here-documents whose operators stood on the line that just ended."""
        for delimiter, dash, number in self.waiting:
            lines = []
            while self.at < len(self.text):
                nl = self.text.find("\n", self.at)
                end = len(self.text) if nl < 0 else nl
                line = self.text[self.at : end]
                self.at = min(end + 1, len(self.text))
                if (line.lstrip("\t") if dash else line) == delimiter:
                    break
                lines.append(line)
            self.bodies[number] = "\n".join(lines)
        self.waiting = []


@dataclass
class Group:
    closes: str
    parent: Group | None
    tags: set = field(default_factory=lambda: {"unknown"})

    def all_tags(self) -> set:
        return self.tags | (self.parent.all_tags() if self.parent else set())


@dataclass
class Segment:
    tokens: list[Token]
    group: Group | None
    pipe: int

    @property
    def texts(self) -> list[str]:
        return [t.text for t in self.tokens]

    @property
    def tags(self) -> set:
        return self.group.all_tags() if self.group else set()


def _group_tags(tokens: list[Token], i: int) -> set:
    """What is done with a group's output, from what follows its close."""
    tags, target = set(), False
    for k in range(i, len(tokens)):
        t = tokens[k]
        if t.operator and t.text in REDIRECTS:
            tags.add("redirect")
            target = True
        elif t.operator and t.text in ("|", "|&"):
            tags.add("pipe")
            break
        elif t.operator or (not t.quoted and (t.text == "}" or t.text in CONSTRUCT_ENDS)):
            break
        elif target:
            target = False
        elif not (t.text.isdigit() and k + 1 < len(tokens) and tokens[k + 1].operator and tokens[k + 1].text in REDIRECTS):
            tags.add("unknown")
    return tags


def segments(tokens: list[Token]) -> list[Segment]:
    """Tokens folded into segments; ``pipe`` numbers the pipelines."""
    out: list[Segment] = []
    held: list[Token] = []
    groups: list[Group] = []
    pipe = 0

    def end_segment():
        if held:
            out.append(Segment(list(held), groups[-1] if groups else None, pipe))
            held.clear()

    for i, t in enumerate(tokens):
        bare = not t.operator and not t.quoted
        opens = (t.operator and t.text == "(") or (bare and t.text == "{" and not held)
        closes = (t.operator and t.text == ")") or (bare and t.text == "}" and not held)
        if opens or closes or (t.operator and t.text in SEPARATORS):
            end_segment()
            pipe += 1
            if opens:
                groups.append(Group(")" if t.text == "(" else "}", groups[-1] if groups else None))
            elif closes and groups and groups[-1].closes == t.text:
                groups.pop().tags = _group_tags(tokens, i + 1)
        elif t.operator and t.text in ("|", "|&"):
            end_segment()
        elif not held and bare and t.text in RESERVED:
            continue
        else:
            held.append(t)
    end_segment()
    return out


def operands(tokens: list[Token]) -> list[str]:
    """Positional words after the first: no flags, no redirects or their targets."""
    out, skip = [], False
    for t in tokens[1:]:
        if skip:
            skip = False
        elif t.operator:
            skip = t.text in REDIRECTS
        elif not t.text.startswith("-"):
            out.append(t.text)
    return out


def _git_call(words: list[str]) -> dict | None:
    if not words or words[0] != "git":
        return None
    i, configs = 1, {}
    while i < len(words) and words[i].startswith("-"):
        if words[i] == "-c" and i + 1 < len(words):
            key = words[i + 1].split("=", 1)[0].lower()
            configs.pop(key, None)  # the last setting of a key counts, in its own place
            configs[key] = words[i + 1]
        i += 2 if words[i] in GIT_VALUED else 1
    if i >= len(words):
        return None
    args = words[i + 1 :]
    return {"sub": words[i], "args": args, "configs": list(configs.values()), "message": _git_message(args)}


def _git_message(args: list[str]) -> str | None:
    follows = lambda k: args[k + 1] if k + 1 < len(args) else None
    for k, a in enumerate(args):
        if a == "--":
            return None
        if a in ("-m", "--message"):
            return follows(k)
        if a.startswith("--message="):
            return a.partition("=")[2]
        if re.match(r"-[^-]*m", a):
            before, _, after = a[1:].partition("m")
            if set(before) <= GIT_SHORT_ALONE:
                return after or follows(k)
    return None


def normalise(command: str) -> str:
    """Blanks collapsed, a leading ``cd DIR &&`` gone."""
    words = command.split()
    if words[:1] == ["cd"]:
        rest = " ".join(words[1:])
        i = joined = 0
        while i < len(rest) and rest[i] != " ":  # the folder, to the first blank that no backslash hides
            if i and rest.startswith("&&", i):
                joined = i
            i += 2 if rest[i] == "\\" else 1
        if i and rest[i:].lstrip().startswith("&&"):
            return rest[i:].lstrip()[2:].strip()
        if joined:
            return rest[joined + 2 :].strip()
    return " ".join(words)


PARSE = (
    "struct<skipped:boolean,command:string,normalised:string,heredocs:array<string>,"
    "segments:array<struct<tokens:array<string>,words:array<string>,assigned:array<string>,n_operands:int,program:string,first_operand:string,redirected:boolean,unsure:boolean,alone:boolean>>,"
    "git:array<struct<sub:string,args:array<string>,tokens:array<string>,configs:array<string>,message:string,message_unread:boolean,configs_unread:boolean>>>"
)


def parse(command) -> dict:
    """The parse of one command; ``skipped`` if it is no text, empty, too long or does not parse."""
    text = command if isinstance(command, str) else ""
    skipped = {"skipped": True, "command": text, "normalised": "", "heredocs": [], "segments": [], "git": []}
    if not text or len(text) > MAX_COMMAND:
        return skipped
    reader = _Reader(text)
    try:
        found = segments(reader.tokens())
    except (Unparsable, RecursionError):
        return skipped
    in_pipe: dict[int, int] = {}
    for s in found:
        in_pipe[s.pipe] = in_pipe.get(s.pipe, 0) + 1
    segs, git = [], []
    for s in found:
        texts = s.texts
        n = next((k for k, t in enumerate(s.tokens) if t.operator or not _ASSIGNMENT.match(t.text)), len(texts))
        words = s.tokens[n:]
        plain = [t.text for t in words]
        stepped, skip = [], False
        for k, t in enumerate(words):
            if skip:
                skip = False
            elif k and t.text in VALUED_FLAGS and not t.operator:
                skip = True
            else:
                stepped.append(t)
        given = operands(stepped)
        segs.append(
            {
                "tokens": texts, "words": plain, "assigned": [x.split("=", 1)[0] for x in texts[:n]], "n_operands": len(operands(s.tokens)),
                "program": plain[0].rsplit("/", 1)[-1] if plain else None, "first_operand": given[0] if given else None,
                "redirected": any(t.operator and t.text in REDIRECTS for t in s.tokens) or "redirect" in s.tags,
                "unsure": "unknown" in s.tags, "alone": in_pipe[s.pipe] == 1 and "pipe" not in s.tags,
            }
        )
        if call := _git_call(plain):
            unread = lambda x: bool(_UNRESOLVED.search(x))
            git.append(call | {"tokens": texts, "message_unread": call["message"] is not None and unread(call["message"]), "configs_unread": any(map(unread, call["configs"]))})
    return {"skipped": False, "command": text, "normalised": normalise(text), "heredocs": reader.bodies, "segments": segs, "git": git}


def with_parse(events, command="command", out="parse"):
    """Adds the parse of the column ``command`` (NULL where that is NULL) in one pass over Arrow batches."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields if f.name != out) + f", `{out}` {PARSE}"
    kept = [c for c in events.columns if c != out]
    kind = to_arrow_type(StructType.fromDDL(f"p {PARSE}")[0].dataType)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            memo: dict = {}
            parsed = [None if t is None else memo[t] if t in memo else memo.setdefault(t, parse(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(parsed, kind)], names=[*batch.schema.names[:-1], out])

    return events.select(*kept, F.col(command).alias("__command")).mapInArrow(run, schema)

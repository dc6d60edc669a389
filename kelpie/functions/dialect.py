"""Character classes that make Java's regex engine agree with Python's on Unicode text."""

# Fixed values.
LETTERS = r"\p{L}\p{N}_"
WORD = rf"[{LETTERS}]"
DIGIT = r"\p{Nd}"
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\s\x1c-\x1f\x85\p{Z}]"
BOUNDARY = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"


def java(shape: str) -> str:
    """A shape whose classes are written <edge>, <w> (inside brackets), <digit>, <space> and <nonspace>, for Spark."""
    return shape.replace("<edge>", BOUNDARY).replace("<w>", LETTERS).replace("<digit>", DIGIT).replace("<space>", SPACE).replace("<nonspace>", NOT_SPACE[1:-1])


def python(shape: str) -> str:
    """The same for Python's re."""
    return shape.replace("<edge>", r"\b").replace("<w>", r"\w").replace("<digit>", r"\d").replace("<space>", r"\s").replace("<nonspace>", r"^\s")

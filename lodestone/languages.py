"""What is known of each language, one row a language; a new language is a row here and a front end."""

from __future__ import annotations

from dataclasses import dataclass

from .parsing.model import FrontEnd

# Names that a language brings along.
_PYTHON_BUILTINS = """
abs all any ascii bin bool bytearray bytes callable chr classmethod compile complex delattr dict dir divmod enumerate
eval exec filter float format frozenset getattr globals hasattr hash help hex id input int isinstance issubclass
iter len list locals map max memoryview min next object oct open ord pow print property range repr reversed round
set setattr slice sorted staticmethod str sum super tuple type vars zip __import__ Exception ValueError TypeError
RuntimeError KeyError IndexError AttributeError ImportError
"""
_GO_BUILTINS = """
append cap clear close complex copy delete imag len make new panic print println real recover int int8 int16 int32
int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 string bool byte rune error
"""
_SCRIPT_BUILTINS = """
console Math JSON Object Array String Number Boolean Date RegExp Error Promise Map Set WeakMap WeakSet Symbol Proxy
Reflect parseInt parseFloat isNaN isFinite decodeURI decodeURIComponent encodeURI encodeURIComponent setTimeout
clearTimeout setInterval clearInterval window document fetch process require module exports
"""


@dataclass(frozen=True)
class Language:
    name: str
    extension: str
    front_end: str  # module:function
    builtins: frozenset[str]
    self_names: tuple[str, ...]
    index_file: str | None = None
    footer: str | None = None
    submodules: bool = False  # "from m import n" may name a module n
    dotted_modules: bool = False  # a.b.c is the path a/b/c
    relative_imports: bool = False
    directories: bool = False  # an import names a directory


REGISTRY = (
    Language("python", ".py", "lodestone.parsing.python_source:parse", frozenset(_PYTHON_BUILTINS.split()), ("self", "cls"), "__init__.py", None, True, True, True),
    Language("typescript", ".ts", "lodestone.parsing.brace_source:parse_typescript", frozenset(_SCRIPT_BUILTINS.split()), ("this",), "index.ts", "}"),
    Language("javascript", ".js", "lodestone.parsing.brace_source:parse_javascript", frozenset(_SCRIPT_BUILTINS.split()), ("this",), "index.js", "}"),
    Language("go", ".go", "lodestone.parsing.brace_source:parse_go", frozenset(_GO_BUILTINS.split()), (), None, None, True, False, False, True),
)
BY_NAME = {x.name: x for x in REGISTRY}
BY_EXTENSION = {x.extension: x for x in REGISTRY}


def front_end(language: str) -> FrontEnd:
    """The function that parses a file of this language."""
    from importlib import import_module

    from .errors import LanguageLoadError, UnregisteredLanguageError

    if language not in BY_NAME:
        raise UnregisteredLanguageError(language)
    module, _, name = BY_NAME[language].front_end.partition(":")
    try:
        return getattr(import_module(module), name)
    except (ImportError, AttributeError) as error:
        raise LanguageLoadError(language) from error


def check(registry: tuple[Language, ...] = REGISTRY) -> None:
    """Raises ImportError unless names and extensions are unique and every front end is there and keeps to the protocol."""
    from .errors import LanguageLoadError
    from .parsing.model import Source

    for field in ("name", "extension"):
        if len({getattr(x, field) for x in registry}) < len(registry):
            raise ImportError(f"two languages have the same {field}")
    for x in registry:
        if not x.extension.startswith("."):
            raise ImportError(f"{x.name}: extension {x.extension!r}")
        try:
            found = front_end(x.name)(b"")
        except (KeyError, TypeError, LanguageLoadError) as error:
            raise ImportError(f"{x.name}: {error!r}") from error
        if not isinstance(found, Source):
            raise ImportError(f"{x.name}: its front end gives {type(found).__name__}")


check()

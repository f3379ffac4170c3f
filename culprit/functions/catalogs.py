"""Name catalogs: language primitives, noise words, stop words.

Fixed values: results depend on exactly these names, so they are listed as they are.
"""

from __future__ import annotations


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Exceptions that no project defines.
EXCEPTIONS = _names(
    """
    AttributeError BaseException ConnectionError Exception FileNotFoundError GeneratorExit ImportError
    IndexError IOError IsADirectoryError KeyboardInterrupt KeyError MemoryError NotImplementedError OSError
    OverflowError PermissionError RecursionError RuntimeError StopIteration SystemExit TimeoutError TypeError
    ValueError ZeroDivisionError
    """
)

#: Base classes of the language and its library.
BASE_CLASSES = _names(
    """
    ABC abc.ABC abc.ABCMeta ABCMeta auto bool bytearray bytes ChainMap collections.ChainMap
    collections.Counter collections.defaultdict collections.deque collections.OrderedDict complex Counter
    defaultdict deque dict Enum enum.Enum enum.Flag enum.IntEnum enum.IntFlag enum.StrEnum Flag float
    frozenset Generic int IntEnum IntFlag list Lock memoryview NamedTuple object OrderedDict Protocol set str
    StrEnum Thread tuple type TypedDict typing.Generic typing.NamedTuple typing.Protocol typing.TypedDict
    UserDict UserList UserString
    """
)

#: Decorators of the language and its library.
DECORATORS = _names(
    """
    abc.abstractmethod abc.abstractproperty abstractclassmethod abstractmethod abstractproperty
    abstractstaticmethod asynccontextmanager cache cached_property classmethod contextlib.asynccontextmanager
    contextlib.contextmanager contextmanager dataclass dataclasses.dataclass final functools.cache
    functools.cached_property functools.lru_cache functools.partial functools.singledispatch
    functools.singledispatchmethod functools.total_ordering functools.wraps lru_cache no_type_check overload
    partial property runtime_checkable singledispatch singledispatchmethod staticmethod total_ordering
    typing.final typing.no_type_check typing.overload typing.runtime_checkable wraps
    """
)

#: Method names that belong to built-in types, by the type that has them first.
METHODS = frozenset().union(
    # str
    _names(
        """
        capitalize casefold center count encode endswith expandtabs find format format_map index isalnum isalpha
        isascii isdecimal isdigit isidentifier islower isnumeric isprintable isspace istitle isupper join ljust
        lower lstrip maketrans partition removeprefix removesuffix replace rfind rindex rjust rpartition rsplit
        rstrip split splitlines startswith strip swapcase title translate upper zfill
        """
    ),
    # bytes
    _names(
        """
        decode fromhex hex
        """
    ),
    # list and deque
    _names(
        """
        append clear copy extend insert pop remove reverse sort
        """
    ),
    # dict
    _names(
        """
        fromkeys get items keys popitem setdefault update values
        """
    ),
    # set
    _names(
        """
        add difference difference_update discard intersection intersection_update isdisjoint issubset issuperset
        symmetric_difference symmetric_difference_update union
        """
    ),
    # file
    _names(
        """
        close flush read readable readline readlines seek seekable tell writable write writelines
        """
    ),
    # generator
    _names(
        """
        send throw
        """
    ),
    # re.Match
    _names(
        """
        end group groupdict groups span start
        """
    ),
    # pathlib.Path
    _names(
        """
        absolute as_posix as_uri exists is_dir is_file is_symlink relative_to resolve with_name with_stem
        with_suffix
        """
    ),
    # threading
    _names(
        """
        acquire is_alive notify notify_all release wait
        """
    ),
)

#: Callables of the interpreter (3.13), without the two catalogs above.
FUNCTIONS = _names(
    """
    abs aiter all anext any ArithmeticError ascii AssertionError BaseExceptionGroup bin BlockingIOError
    breakpoint BrokenPipeError BufferError BytesWarning callable ChildProcessError chr classmethod compile
    ConnectionAbortedError ConnectionRefusedError ConnectionResetError copyright credits delattr
    DeprecationWarning dir divmod EncodingWarning enumerate EnvironmentError EOFError eval ExceptionGroup exec
    exit FileExistsError filter FloatingPointError format FutureWarning getattr globals hasattr hash help hex
    id ImportWarning IndentationError input InterruptedError isinstance issubclass iter len license locals
    LookupError map max min ModuleNotFoundError NameError next NotADirectoryError oct open ord
    PendingDeprecationWarning pow print ProcessLookupError property PythonFinalizationError quit range
    ReferenceError repr ResourceWarning reversed round RuntimeWarning setattr slice sorted staticmethod
    StopAsyncIteration sum super SyntaxError SyntaxWarning SystemError TabError UnboundLocalError
    UnicodeDecodeError UnicodeEncodeError UnicodeError UnicodeTranslateError UnicodeWarning UserWarning vars
    Warning zip
    """
)

#: Top-level modules of the standard library that count as such.
LIBRARY_MODULES = _names(
    """
    abc argparse ast asyncio collections contextlib copy csv dataclasses datetime decimal enum functools
    hashlib http importlib importlib_metadata inspect io itertools json logging math operator os pathlib
    pickle platform random re shutil socket ssl statistics string subprocess sys tempfile textwrap threading
    time tokenize traceback types typing urllib uuid warnings weakref
    """
)

#: Words that never become incident keywords.
NOISE_WORDS = _names(
    """
    about above also an and any are as at attribute be been but by call can could did do does during error
    exception file for from had handling has have how if in into is it its last line may might more most no
    nonetype not object occurred of on or recent should so than that the their then there they this to
    traceback type was were what when where which will with would
    """
)

#: Words that the text index leaves out.
STOP_WORDS = _names(
    """
    a an and as at be by do for if in is it not of on or the to up we
    """
)

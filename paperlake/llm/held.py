"""What a Python worker keeps between tasks, such as tokenizers with their words: one thing at a time.

Workers are used again by later stages. What an earlier stage kept would stay beside a later one's own
memory, so asking for something else drops it.
"""

from paperlake.memory import trim

_held = {}


def held(key, make):
    """What is kept under `key`, made anew when something else was kept meanwhile."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Drop what is kept, and give freed memory back to the system where the C library can: an
    operator that keeps nothing itself begins with that."""
    _held.clear()
    trim()


def trimmed(run):
    """`run` over Arrow batches, with the freed memory given back after the last one."""

    def trimming(batches):
        yield from run(batches)
        trim()

    return trimming

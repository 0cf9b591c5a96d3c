from helpers import load, store as keep


def func_a(x):
    """Loads what x names and returns it."""
    return load(x)


def func_b():
    return func_a(1)


class Box(object):
    """A box."""

    async def func_c(self, *, deep: bool = True) -> int:
        return len(self.items())

"""Training-data operators over the ``documents`` and ``pages`` tables; nothing else in the library imports this package."""

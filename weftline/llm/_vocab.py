"""Where the public tokenizers' vocabulary files are."""

from __future__ import annotations

import os

#: Folder of the vocabulary files; a parameter, never copied into the repository.
FOLDER = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def tokenizer_path(name: str) -> str:
    """Path of a vocabulary file: of the installed package, else under FOLDER."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(FOLDER, name)
    return public_tokenizers.path(name)

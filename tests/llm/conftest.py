import os

import pytest

TOKENIZERS = "/opt/tokenizers"


@pytest.fixture(scope="session")
def vocabulary():
    if not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"):
        pytest.skip("public vocabulary files are not there")
    return TOKENIZERS

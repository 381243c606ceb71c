from statepath.functions.vectors import (
    js_divergence,
    kl_divergence,
    pack_array,
    portable_uniform,
    vector_element,
)

__all__ = ["js_divergence", "kl_divergence", "pack_array", "portable_uniform", "vector_element"]

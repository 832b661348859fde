"""Structure extraction: one module per language, registered in ``registry``."""

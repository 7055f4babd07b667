"""Token streams, grammars and the derivative parser of the supported languages."""

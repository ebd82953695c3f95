"""Training-data operators: ten corpus-scale stages over ``documents`` and ``pages``.

Nothing outside this subpackage imports it.  ``queries.py`` lists the registered
queries; each operator module holds the general operator and its thin query.
"""

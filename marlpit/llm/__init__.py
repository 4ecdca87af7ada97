"""Operators of a training-data pipeline over `documents`, `pages` and `embeddings`.

One module for each operator; `queries` registers them. Nothing outside this
package imports it.
"""

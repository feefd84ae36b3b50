"""Training-data operators: thirteen corpus operations that stand beside the receipt engine.

Nothing outside this package imports it.
"""

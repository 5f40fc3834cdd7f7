"""Scalar and array functions: Column builders where Catalyst can express them, Arrow functions elsewhere."""

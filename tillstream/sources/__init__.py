"""Tables and schemas."""

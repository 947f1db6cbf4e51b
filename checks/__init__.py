"""Every operator bound to the driver tables, with its SQL counterpart."""

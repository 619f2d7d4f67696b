"""Options of a command, folded into columns on the driver."""
